"""JSON lines, JSON documents, split folders, lookups, manifests and append logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import whole_json


def read_lines(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one fails the read, or is dropped if not strict.

    missing_ok: a missing file is an empty table, and lines that aren't objects are dropped; an empty object, or one of
    other keys, is a row of nulls.
    """
    try:
        if not missing_ok:
            return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
        lines = spark.read.text(path).where(F.trim("value") != "")
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    v = whole_json(F.col("value"))
    if strict:
        v = F.when(v.isNull(), F.raise_error(F.concat(F.lit("malformed JSON line: "), F.col("value"))).cast("variant")).otherwise(v)
    objects = lines.select(v.alias("v"), "value").where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    return objects.select(F.from_json("value", ddl).alias("t")).select("t.*")


def read_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_tasks(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tasks of a file that holds a JSON array, an object with ``examples``, one object, or JSON lines (malformed ones dropped).

    ValueError if there are none. The whole file is one value where it is a document, so this suits files, not corpora;
    corpora are JSON lines.
    """
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    whole = spark.read.text(path, wholetext=True).select(whole_json(F.col("value")).alias("v"))
    kind = F.schema_of_variant("v")
    examples = F.try_variant_get("v", "$.examples", "variant")
    array = F.when(F.startswith(kind, F.lit("ARRAY")), F.col("v")).when(F.startswith(F.schema_of_variant(examples), F.lit("ARRAY")), examples)
    whole = whole.withColumn("kind", kind).withColumn("items", array)
    one = whole.where("items is null and kind like 'OBJECT%'").select(F.col("v").alias("item"))
    many = whole.where("items is not null").select(F.explode(F.col("items").cast("array<variant>")).alias("item"))
    items = many.unionByName(one).where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    parsed = items.select(F.from_json(F.to_json("item"), ddl).alias("t")).select("t.*")
    if parsed.limit(1).count():
        return parsed
    lines = spark.read.text(path).where(F.trim("value") != "").select(whole_json(F.col("value")).alias("item"))
    parsed = lines.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))).select(F.from_json(F.to_json("item"), ddl).alias("t")).select("t.*")
    if not parsed.limit(1).count():
        raise ValueError(f"no tasks in {path}")
    return parsed


def read_splits(spark: SparkSession, root: str, schema: StructType | str, splits: tuple[str, ...] = ("train", "dev", "held_out")) -> DataFrame:
    """<root>/<split>/*.jsonl of each split that exists, with column split."""
    out = None
    for s in splits:
        df = read_lines(spark, f"{root}/{s}/*.jsonl", schema, missing_ok=True).withColumn("split", F.lit(s))
        out = df if out is None else out.unionByName(df)
    return out


def with_pos(df: DataFrame) -> DataFrame:
    """Rows of files with column pos in order of file and row, for operators that go by order."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(F.col("_metadata.file_path"), F.monotonically_increasing_id())))


def outputs_map(df: DataFrame, key: str = "task_id", pos: str = "pos") -> DataFrame:
    """The last row of each trimmed, non-blank key; text fields trimmed."""
    from quern.operators.selection import dedupe

    text = [c for c, t in df.dtypes if t == "string"]
    return dedupe(df.withColumns({c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "") for c in text}), key, pos, last=True)


def write_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append a batch to a log folder; each call adds files of its own, so writers don't need a lock."""
    df.write.mode("append").json(path)


def report_json(df: DataFrame) -> str:
    """The single row of a report as indented JSON."""
    import json

    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]), indent=2)


def report_markdown(df: DataFrame, title: str) -> str:
    row = df.first().asDict()
    return "\n".join([f"# {title}", "", *(f"- {k}: {v}" for k, v in row.items()), ""])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_named(spark: SparkSession, files: dict[str, str], schema: StructType | str) -> DataFrame:
    """JSON lines of each named split's path, with column split; a missing file fails the read."""
    out = None
    for s, path in files.items():
        df = read_lines(spark, path, schema).withColumn("split", F.lit(s))
        out = df if out is None else out.unionByName(df)
    return out


def from_rows(spark: SparkSession, rows: list[dict], schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    """A small table held by the driver, cut to ``columns``; fields that a row lacks are null."""
    df = spark.createDataFrame(rows, schema)
    return df.select(*columns) if columns else df


def training_log(lines: DataFrame) -> DataFrame:
    """(step, loss) of the lines of a training log (column value, JSON) that have both; all other lines are passed over."""
    v = whole_json(F.col("value"))
    got = lines.select(F.try_variant_get(v, "$.step", "bigint").alias("step"), F.try_variant_get(v, "$.loss", "double").alias("loss"))
    return got.where("step is not null and loss is not null")
