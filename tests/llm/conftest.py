import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quern_to int, score double, row bigint, slot int, path string"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Rows (doc_id, text[, lang[, source]]) as a Parquet table with extra columns of clashing names."""

    def make(rows, files=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), 1, 0.5, 3, 4, "p") for r in rows]
        where = str(tmp_path_factory.mktemp("t") / "documents.parquet")
        spark.createDataFrame(full, SCHEMA).coalesce(files).write.parquet(where)
        return where

    return make


LONG = "alpha beta gamma delta " * 20_000
EDGES = [(1, None), (2, ""), (None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, None), (4, LONG), (5, "###"), (6, "Ünïcødé «quotes» \t\n\n x"), (None, "", None, None)]
