"""From raw documents to a placed training set: STAGES in order, each reading what the one before it wrote.

Every stage takes any rows: a null or empty text has no language and goes in the first stage; very long texts count whole; ties are
settled by the smallest doc_id, then by the place in the files (null ids last); repeated rows are copies of each other, of
which one stays; a null source or language is a value of its own; columns of any other name, also of one that a stage uses itself, are
carried along; an empty table gives an empty one with the same columns, and old_shard and new_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common, contamination, jaccard, language, mixing, sharding


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is fitted on a bounded sample of these rows' own labels."""
    return language.keep_identified(docs, language.fit(docs, **language.PARAMS), language.PARAMS["min_margin"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents of similar n-gram sets."""
    return jaccard.keep_one(docs, **jaccard.PARAMS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim passage of the benchmark."""
    return contamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"), **contamination.PARAMS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares of tokens."""
    return mixing.mix(docs, **mixing.PARAMS)


def sharding_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with old_shard and new_shard."""
    return sharding.place(docs, **sharding.PARAMS)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_),
]

#: SQL can't express the flow network of the last stage; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and those of the stage before deleted."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
