"""Corpus operators for preparing training data: language, quality, mixing, licences, duplicates, contamination, HTML, shards.

Nothing outside this folder imports it; ``quern.llm.registry`` holds the queries and their SQL.
"""
