"""Structured Streaming: an extension, for logs that grow."""
