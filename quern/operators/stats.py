"""Summaries, percentiles, paired bootstrap, ratios and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.safe import safe_ratio


def summarize(df: DataFrame, by: list[str], values: list[str], passed: str | None = None, digits: int = 6) -> DataFrame:
    """n, mean and median of each value, and the pass rate, by group; medians and percentiles interpolate linearly."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.round(F.coalesce(F.avg(v), F.lit(0.0)), digits).alias(f"mean_{v}"), F.round(F.coalesce(F.percentile(v, F.lit(0.5)), F.lit(0.0)), digits).alias(f"median_{v}")]
    if passed:
        aggs.append(F.round(F.coalesce(F.avg(F.col(passed).cast("int")), F.lit(0.0)), digits).alias("pass_rate"))
    return df.groupBy(*by).agg(*aggs)


def paired_diffs(df: DataFrame, key: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """(key, diff): value of variant a minus that of b, for keys that have both; one shuffle by key."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    return df.groupBy(key).agg(pick(a).alias("a"), pick(b).alias("b")).where("a is not null and b is not null").select(key, (F.col("a") - F.col("b")).alias("diff"))


def bootstrap(diffs: DataFrame, order: str, iterations: int = 5000, seed: int = 42) -> DataFrame:
    """One row: n, mean, 95 % interval and p-values of a paired bootstrap over column diff.

    Draw j of iteration i takes the row numbered sha256(seed|i|j) modulo n, so any engine draws the same rows. The
    differences travel as one array: n is the number of paired tasks, iterations are the parallel dimension.
    """
    arr = diffs.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "diff"))), lambda x: x["diff"]).alias("d"))
    spark = diffs.sparkSession
    n = F.size("d")
    draw = lambda j: F.element_at("d", (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("it"), j), 256), 1, 8), 16, 10).cast("bigint") % n + 1).cast("int"))
    # the array is used once, so that what makes the differences runs once; its one row meets the iterations
    it = spark.range(0, iterations, 1, spark.sparkContext.defaultParallelism).select(F.col("id").alias("it")).crossJoin(F.broadcast(arr))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    mean = F.when(n > 0, total(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), draw)) / n)
    r = it.select(mean.alias("m"), n.alias("n"), F.when(n > 0, total(F.col("d")) / n).otherwise(0.0).alias("mean_diff"))
    p = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 1) / F.lit(iterations + 1)
    out = r.agg(F.first("n").alias("n"), F.first("mean_diff").alias("mean_diff"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.count_if(F.col("m") <= 0).alias("le"), F.count_if(F.col("m") >= 0).alias("ge"))
    none = F.col("n") == 0
    return out.select(
        F.col("n").cast("bigint").alias("n"), F.round("mean_diff", 6).alias("mean_diff"), F.round(F.coalesce("lo", F.lit(0.0)), 6).alias("ci_low"), F.round(F.coalesce("hi", F.lit(0.0)), 6).alias("ci_high"),
        F.round(F.when(none, 1.0).otherwise(p("le")), 6).alias("p_one"), F.round(F.when(none, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least(p("le"), p("ge")))), 6).alias("p_two"),
    )


def significant(b: DataFrame, level: float = 0.05) -> DataFrame:
    return b.withColumn("significant", (F.col("n") > 0) & (F.col("ci_low") > 0) & (F.col("p_one") < level))


def ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, F.round(safe_ratio(F.col(a), F.col(b)), 6))


def mean_differences(df: DataFrame, variant: str, a: str, b: str, values: list[str]) -> DataFrame:
    """One row: mean of variant a minus mean of variant b of each value (score, cost, latency), null where a variant has none."""
    mean = lambda v, of: F.avg(F.when(F.col(variant) == of, F.col(v)))
    return df.where(F.col(variant).isin(a, b)).agg(*(F.round(mean(v, a) - mean(v, b), 6).alias(f"{v}_delta") for v in values))


def external_delta(df: DataFrame, by: str, value: str, external: float) -> DataFrame:
    """(by, mean, external, delta, informational): each group's mean against a constant from elsewhere, for information only."""
    m = df.groupBy(by).agg(F.avg(value).alias("m"))
    return m.select(by, F.round("m", 6).alias("mean"), F.lit(float(external)).alias("external"), F.round(F.col("m") - external, 6).alias("delta"), F.lit(True).alias("informational"))


def scale_counts(base: DataFrame, total: int) -> DataFrame:
    """base (pos, key, n) with ``scaled``: shares of total, halves to even; what is over or short goes to the first key."""
    from pyspark.sql import Window

    everything = Window.partitionBy()
    sum_ = F.sum("n").over(everything)
    s = base.withColumn("sum_", sum_).withColumn("r", F.when(F.col("sum_") > 0, F.bround(F.col("n") * F.lit(total) / F.col("sum_"), 0).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    short = F.when(F.col("sum_") > 0, F.lit(total) - F.sum("r").over(everything)).otherwise(F.lit(0))
    first = F.col("pos") == F.min("pos").over(everything)
    return s.select("pos", "key", "n", (F.col("r") + F.when(first, short).otherwise(0)).cast("bigint").alias("scaled"))
