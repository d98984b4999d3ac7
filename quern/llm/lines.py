"""Line de-duplication with levelled sorted runs of line hashes.

Documents come in batches. The lines seen so far are runs: tables bucketed and sorted by line hash, in levels. A new batch is
reduced to its own first occurrences, merge-anti-joined with every run, and what is left becomes a run of level 0. When a
level has ``fanout`` runs they are merged into one run of the next level, so that n batches leave about
fanout * log(n) runs, and each line is rewritten about log(n) times.

Runs with a name outlive the call: a file in the shared folder lists them, and the next delivery is de-duplicated against them.

Runs are bucketed alike, so neither the joins nor the compaction shuffle them. Each entry keeps the place of the line it
stands for; the runs together are the lines that stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Parameters in production. batches: arrivals that the table is taken as, by ranges of doc_id.
PARAMS = {"batches": 4, "fanout": 2}
_LINE = "batch int, id_null boolean, doc_id bigint, row bigint, line int, h1 bigint, h2 bigint"
_KEY = ["h1", "h2"]
_PLACE = ("id_null", "doc_id", "row", "line")
_RUN = "h1 bigint, h2 bigint, id_null boolean, doc_id bigint, row bigint, line int, delivery int"


class Runs:
    """Levelled runs of line hashes in the shared folder. With a ``name``, those that it had before are opened again.

    The list of runs is replaced when a batch is in, and only then are merged runs deleted: after a failure the
    list still names whole runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = PARAMS["fanout"], name: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []
        self.delivery = 0
        self.base = f"{common.shared_dir(spark)}/quern-state-lines-{name or uuid.uuid4().hex}"
        self.list = f"{self.base}/runs.json"
        if name is not None and common.exists(spark, self.list):
            known = json.loads(common.read_text(spark, self.list))
            self.levels, self.buckets, self.delivery = known["levels"], known["buckets"], known["delivery"] + 1
            for run in self.names():
                spark.sql(f"create table if not exists {run} ({_RUN}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.base}/{run}'")

    def _write(self, df: DataFrame) -> str:
        name = f"quern_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.base}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        common.release(self.spark, [f"{self.base}/{name}"])

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (h1, h2, id_null, doc_id, row, line): of each new hash pair its first place."""
        fresh = batch.groupBy(*_KEY).agg(F.min(F.struct(*_PLACE)).alias("at")).select(*_KEY, *(F.col(f"at.{c}") for c in _PLACE), F.lit(self.delivery).alias("delivery"))
        for name in self.names():
            fresh = fresh.join(self.spark.table(name).select(*_KEY).hint("merge"), _KEY, "left_anti")
        levels, merged = [*map(list, self.levels)] or [[]], []
        levels[0].append(self._write(fresh))
        at = 0
        while len(levels[at]) >= self.fanout:
            union = self.spark.table(levels[at][0])
            for name in levels[at][1:]:
                union = union.unionByName(self.spark.table(name))
            new = self._write(union)
            merged += levels[at]
            levels[at] = []
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(new)
            at += 1
        self.levels = levels
        common.write_text(self.spark, self.list, json.dumps({"levels": levels, "buckets": self.buckets, "delivery": self.delivery}))
        for name in merged:
            self._drop(name)

    def all(self) -> DataFrame | None:
        out = None
        for name in self.names():
            t = self.spark.table(name)
            out = t if out is None else out.unionByName(t)
        return out

    def close(self, delete: bool = True) -> None:
        """Forget the runs; with ``delete`` their files go too."""
        for name in self.names():
            self.spark.sql(f"drop table if exists {name}")
        self.levels = []
        if delete:
            common.release(self.spark, [self.base])


def _hash(batches: Iterator[pa.RecordBatch], files: dict[str, int], bounds: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = common.addresses(files, b.column("path"), b.column("at")).tolist()
        which, ids, at, line, h1, h2 = [], [], [], [], [], []
        for row, doc, text in zip(rows, b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text is None:
                continue
            n = len(bounds) if doc is None else sum(doc > x for x in bounds)
            for i, x in enumerate(text.split("\n")):
                if x.strip(" \t\r"):
                    h = xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass"))
                    which.append(n)
                    ids.append(doc)
                    at.append(row)
                    line.append(i)
                    h1.append(h >> 64)
                    h2.append(h & 0xFFFFFFFFFFFFFFFF)
        signed = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (h1, h2)]
        yield pa.record_batch({"batch": pa.array(which, pa.int32()), "id_null": pa.array([x is None for x in ids], pa.bool_()), "doc_id": pa.array(ids, pa.int64()), "row": pa.array(at, pa.int64()), "line": pa.array(line, pa.int32()), "h1": signed[0], "h2": signed[1]})


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, n_lines, n_removed = [], [], []
        for text, stays in zip(b.column("text").to_pylist(), b.column("stays").to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            keep = set(stays or ())
            left = [x for i, x in enumerate(lines) if i in keep or not x.strip(" \t\r")]
            texts.append(None if text is None else "\n".join(left))
            n_lines.append(len(lines))
            n_removed.append(len(lines) - len(left))
        yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})


def dedup_lines(docs: DataFrame, batches: int = PARAMS["batches"], fanout: int = PARAMS["fanout"], state: str | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of each row of ``docs``: of equal lines in all documents only the first stays.

    Lines are told apart exactly, as 128-bit hashes of their bytes. First means the smallest doc_id (null last), then the first row in
    the input's files, then the first line. Lines of nothing but blanks and tabs always stay. A null text stays null, with
    0 lines; an empty one is one empty line. Repeated rows lose all lines but their first row's. Other columns are ignored.
    An empty table gives no rows. Whole texts of any length are read. Batches and compaction don't change the result.

    With a ``state`` the runs stay under that name in the shared folder: lines of an earlier call's documents are then seen lines.
    """
    spark = docs.sparkSession
    docs, files = common.addressed(docs)
    cuts = docs.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(x) for x in cuts})
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    path = common.scratch_path(spark, "lines")
    source.mapInArrow(lambda b: _hash(b, files, bounds), _LINE).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(_LINE).parquet(path)
    runs = Runs(spark, fanout, state)
    try:
        for k in range(len(bounds) + 1):
            runs.add(lines.where(F.col("batch") == k))
        kept = common.written(runs.all().where(F.col("delivery") == runs.delivery).groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("stays")), "kept-lines")
    finally:
        runs.close(delete=state is None)
    common.release(spark, [path])

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch({"row": pa.array(common.addresses(files, b.column("path"), b.column("at"))), "doc_id": b.column("doc_id"), "text": b.column("text")})

    placed = source.mapInArrow(number, "row bigint, doc_id bigint, text string")
    return placed.join(kept, "row", "left").select("doc_id", "text", "stays").mapInArrow(_rebuild, "doc_id bigint, text string, n_lines bigint, n_removed bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents"), **PARAMS)


SQL = """
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents),
r as (select doc_id, i, line, trim(line, ' ' || chr(9) || chr(13)) = '' or row_number() over (partition by line order by doc_id, i) = 1 as stays from l),
g as (select doc_id, string_agg(line, chr(10) order by i) filter (where stays) as text, count(*)::bigint as n_lines, count(*) filter (where not stays)::bigint as n_removed from r group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(g.text, '') end as text, coalesce(g.n_lines, 0)::bigint as n_lines, coalesce(g.n_removed, 0)::bigint as n_removed
from documents d left join g on g.doc_id = d.doc_id"""
