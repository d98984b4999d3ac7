"""What the corpus operators share: the shared folder, written intermediate tables, row addresses and tokens."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores; texts are lower-cased first.
WORD = re.compile(r"\w+")

_written: list[str] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, it is a folder of our own in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it has to name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quern-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends, and Spark knows its true size.

    by: a column whose values become folders.

    Joins with it are broadcast only below ``spark.sql.autoBroadcastJoinThreshold``, checked by Spark against that size.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")  # the write's shuffle files go when it ends: nothing reads them again
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out.quern_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables from ``written`` that nothing reads any more."""
    for t in tables:
        release(t.sparkSession, [t.quern_path])


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete intermediate tables (all of this process's when no paths are given); DataFrames over them can't be read after."""
    jvm = spark.sparkContext._jvm
    for path in list(_written if paths is None else paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _written:
            _written.remove(path)


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it and then renamed."""
    p, fs = _at(spark, path)
    new, _ = _at(spark, f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(p, False)
    fs.rename(new, p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, quern_row: what an operator adds then can't clash with a name of the input; 'quern_row.*' gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("quern_row")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds few texts as Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


ROW_BITS = 36


class Files(dict):
    """Number of each file by its path; ``bytes``: the size of them all."""

    bytes = 0


def addressed(docs: DataFrame, label: str = "docs") -> tuple[DataFrame, Files]:
    """Rows that can be named: the frame itself if it reads files, else a written copy; and a number for each file.

    A row's address is ``file number << 36 | row in the file``: the same however the scan is split, so it holds when
    executors are lost, and unlike doc_id it is never null or repeated.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = written(docs, label)
    sizes = {r[0]: r[1] for r in docs.select("_metadata.file_path", "_metadata.file_size").distinct().collect()}
    files = Files((p, i) for i, p in enumerate(sorted(sizes)))
    files.bytes = sum(sizes.values())
    return docs, files


def addresses(files: dict[str, int], paths: pa.Array, rows: pa.Array) -> np.ndarray:
    """int64 addresses of a batch's rows."""
    names = pa.array(paths) if not isinstance(paths, (pa.Array, pa.ChunkedArray)) else paths
    d = names.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    numbers = np.array([files[p] for p in d.dictionary.to_pylist()], dtype=np.int64)
    return (numbers[np.asarray(d.indices)] << ROW_BITS) | np.asarray(rows, dtype=np.int64)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Hashes(dict):
    """Memo of word hashes, emptied at a bound so that a worker's memory doesn't grow with the vocabulary."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = word_hash(word)
        return h


def md5_unit(key, seed: str):
    """A column in [0, 1) from md5 of seed and key: the same in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
