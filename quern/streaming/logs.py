"""Roll-up of a growing event log (an extension: the batch operators read whole logs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rollup(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, sum of value and errors by window and event type; rows later than ``late`` are dropped when streaming."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if events.isStreaming else ts
    g = ts.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def follow(spark: SparkSession, path: str, schema, out: str, checkpoint: str, **kw: str) -> None:
    """Append finished windows of the Parquet files under ``path`` to ``out``, up to what is there now."""
    q = rollup(spark.readStream.schema(schema).parquet(path), **kw).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
