"""Exact de-duplication by a stateful stream.

Documents stream in, keyed by digest. The state (RocksDB, on the executors' disks, checkpointed to the shared folder)
keeps for each digest the document that came first: its identifier and the locator of its content, file and row. Nothing expires, and
a state with a name outlives the call: the next one takes in only the files that have come since. A digest seen before is a hit; hits are settled by comparing full bytes, fetched by locator, so that documents of one
digest and different content are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Parameters in production.
PARAMS = {"files_per_batch": 8}
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


KEPT = "digest binary, kept struct<arrived timestamp, id_null boolean, doc_id bigint, path string, row bigint>, batch int"


def _streamed(spark: SparkSession, path: str, files_per_batch: int, digest: Callable[[str], Column], base: str) -> DataFrame:
    """The table in ``base`` with one row for each digest: (digest, kept), kept being arrival, identifier and locator of the first document.

    Arrival is the batch's time: a document of a later batch never displaces one that is kept. The first of a batch is the
    smallest doc_id (null last), then the first locator. A batch that is run again after a failure writes its own folder anew.
    """
    out, log = f"{base}/first", f"{base}/log"
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)
        entry = F.struct(F.current_timestamp().alias("arrived"), F.col("doc_id").isNull().alias("id_null"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
        first = stream.where("text is not null").select(digest("text").alias("digest"), entry.alias("entry")).groupBy("digest").agg(F.min("entry").alias("kept"))
        new = first.where(F.col("kept.arrived") == F.current_timestamp())

        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        run = new.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(sink).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    # without any file no batch ran
    return spark.read.schema(KEPT).parquet(out) if common.exists(spark, out) else spark.createDataFrame([], KEPT)


def _bitmap(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A one-row table (quern_bits) with a bit set for the hash of each key, and the number of bits: 16 a key, 64 Ki to 64 Mi."""
    n = keys.count()
    size = 1 << min(26, max(16, (16 * n).bit_length()))
    b = F.pmod(F.xxhash64(column), F.lit(size))
    words = keys.select(b.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("v")).toArrow()
    dense = np.zeros(size // 64, dtype=np.int64)
    dense[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return keys.sparkSession.createDataFrame([(dense.tolist(),)], "quern_bits array<bigint>"), size


def dedup(spark: SparkSession, path: str, files_per_batch: int = PARAMS["files_per_batch"], digest: Callable[[str], Column] = sha, state: str | None = None) -> DataFrame:
    """(doc_id, keep_id, duplicate) of every row of the Parquet table at ``path``.

    keep_id is the smallest doc_id (null last) of the rows with the same bytes; duplicate is true for all of them but the first
    with that id in the table's files. The number of batches doesn't change the result. With a ``state``, the stream and what it keeps
    stay under that name in the shared folder; a later call for the same folder streams only its new files, and a row
    of an earlier batch is kept whatever its doc_id, so that what was kept once isn't displaced.

    Null texts equal nothing and are never duplicates; empty texts equal each other. Repeated rows are duplicates of the first of
    them. Other columns are ignored, whatever their names. An empty table gives no rows. Texts of any length are compared whole.
    """
    base = common.scratch_path(spark, "exact") if state is None else f"{common.shared_dir(spark)}/quern-state-exact-{state}"
    first = _streamed(spark, path, files_per_batch, digest, base)
    docs = spark.read.parquet(path)
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")]
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest("text").alias("digest"), *where)
    known = first.select("digest", F.col("kept.path").alias("k_path"), F.col("kept.row").alias("k_row"), F.col("kept.doc_id").alias("k_id"), F.col("kept.arrived").alias("arrived"))
    told = common.written(ids.join(known, "digest", "left").withColumn("hit", F.coalesce((F.col("path") != F.col("k_path")) | (F.col("row") != F.col("k_row")), F.lit(False))), "told")
    # full bytes: hits and the documents they hit, by locator
    hits = told.where("hit")
    wanted = common.written(hits.select("digest", "path", "row", "doc_id", F.lit(1).alias("late")).unionByName(hits.select("digest", F.col("k_path").alias("path"), F.col("k_row").alias("row"), F.col("k_id").alias("doc_id"), F.lit(0).alias("late")).distinct()), "wanted")
    if state is None:
        common.release(spark, [base])
    # a bitmap of the hits' digests, at most 8 MB whatever their number, keeps most other texts out of the shuffle
    bits, size = _bitmap(hits.select("digest"), "digest")
    near = docs.select("text", *where, F.pmod(F.xxhash64(digest("text")), F.lit(size)).alias("quern_b")).join(F.broadcast(bits), F.expr("shiftright(quern_bits[int(quern_b / 64)], int(quern_b % 64)) & 1 = 1")).drop("quern_bits", "quern_b")
    content = near.join(wanted, ["path", "row"]).select("digest", "text", F.struct("late", F.col("doc_id").isNull().alias("id_null"), "doc_id", "path", "row").alias("e"))
    content = common.written(content, "content")
    if state is None:
        content = content.withColumn("e", F.col("e").withField("late", F.lit(0)))
    by_bytes = content.groupBy("digest", "text").agg(F.min("e").alias("f"))
    settled = content.join(by_bytes, ["digest", "text"]).select(F.col("e.doc_id").alias("doc_id"), F.col("f.doc_id").alias("keep_id"), (F.col("e") != F.col("f")).alias("duplicate"))
    rest = told.where("not hit").join(wanted.where("late = 0").select("path", "row"), ["path", "row"], "left_anti")
    return rest.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(False).alias("duplicate")).unionByName(settled)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet", **PARAMS)


SQL = """
select doc_id, case when text is null then doc_id else first_value(doc_id) over w end as keep_id, text is not null and row_number() over w > 1 as duplicate
from documents window w as (partition by text order by doc_id)"""
