"""A Spark engine for building, scoring and auditing data sets for language models."""
