"""Leakage-safe splits: groups go whole into train, dev or held_out, in an order drawn by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARES = (0.5, 0.3)


def similarity_key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def drawn(seed: Column | int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.lit("|"), key), 256)


def first_fit(groups: DataFrame, by: list[str], shares: tuple[float, float] = SHARES) -> DataFrame:
    """(by, key, split) from groups (by, key, n, ord): each group in order into the first split with room, else held_out.

    The rule needs each group's predecessors, so it is one fold over the array of a seed's (key, n), inside the JVM.
    """
    arr = F.sort_array(F.collect_list(F.struct("ord", "key", "n")))
    g = groups.groupBy(*by).agg(arr.alias("a"), F.sum("n").alias("total")) if by else groups.agg(arr.alias("a"), F.sum("n").alias("total"))
    g = g.withColumn("t1", F.floor(F.col("total") * shares[0])).withColumn("t2", F.floor(F.col("total") * shares[1]))
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.array().cast("array<string>").alias("o"))

    def step(s: Column, e: Column) -> Column:
        one, two = s["x"] + e["n"] <= F.col("t1"), s["y"] + e["n"] <= F.col("t2")
        where = F.when(one, "train").when(two, "dev").otherwise("held_out")
        return F.struct(F.when(one, s["x"] + e["n"]).otherwise(s["x"]).alias("x"), F.when(~one & two, s["y"] + e["n"]).otherwise(s["y"]).alias("y"), F.concat(s["o"], F.array(where)).alias("o"))

    out = g.select(*by, F.explode(F.arrays_zip(F.col("a"), F.aggregate("a", start, step)["o"].alias("split"))).alias("z"))
    return out.select(*by, F.col("z.a.key").alias("key"), F.col("z.a.ord").alias("ord"), F.col("z.split").alias("split"))


def grouped_split(df: DataFrame, key: Column, pos: str, seed: int = 42, rebalance: bool = True, shares: tuple[float, float] = SHARES) -> DataFrame:
    """df with column split. rebalance moves single rows from the end of held_out to train, then dev, until both are full; that may cut groups."""
    keyed = df.withColumn("quern_key", key)
    groups = keyed.groupBy(F.col("quern_key").alias("key")).agg(F.count("*").alias("n")).withColumn("ord", drawn(seed, F.col("key")))
    placed = keyed.join(first_fit(groups, [], shares).select(F.col("key").alias("quern_key"), "ord", "split"), "quern_key")
    if not rebalance:
        return placed.drop("quern_key", "ord")
    sizes = placed.agg(F.count("*").alias("quern_n"), F.count_if(F.col("split") == "train").alias("quern_a"), F.count_if(F.col("split") == "dev").alias("quern_b"))
    need_a, need_b = F.floor(F.col("quern_n") * shares[0]) - F.col("quern_a"), F.floor(F.col("quern_n") * shares[1]) - F.col("quern_b")
    # only held_out rows are ordered, by the position in which their groups were placed
    held = placed.where("split = 'held_out'").withColumn("quern_back", F.row_number().over(Window.orderBy(F.desc("ord"), F.desc("quern_key"), F.desc(pos)))).crossJoin(sizes)
    moved = held.withColumn("split", F.when(F.col("quern_back") <= need_a, "train").when(F.col("quern_back") <= need_a + need_b, "dev").otherwise("held_out"))
    return placed.where("split <> 'held_out'").drop("quern_key", "ord").unionByName(moved.select(*df.columns, "split"))


def seed_search(df: DataFrame, key: Column, seeds: int, leak: str, shares: tuple[float, float] = SHARES) -> DataFrame:
    """One row: (seed, passed, max_shared) of the best seed, with seeds as rows of one plan.

    leak: a column such that rows of one value, in different splits, share it. Best: no value both in held_out and
    outside; then the fewest such values; then the smallest seed.
    """
    keyed = df.select(key.alias("key"), F.col(leak).alias("leak"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"))
    tried = df.sparkSession.range(seeds).select(F.col("id").cast("int").alias("seed"))
    placed = first_fit(tried.crossJoin(groups).withColumn("ord", drawn(F.col("seed"), F.col("key"))), ["seed"], shares)
    spread = placed.join(keyed, "key").groupBy("seed", "leak").agg((F.max((F.col("split") == "held_out").cast("int")) * F.max((F.col("split") != "held_out").cast("int"))).alias("both"))
    scored = spread.groupBy("seed").agg(F.sum("both").alias("max_shared")).withColumn("passed", F.col("max_shared") == 0)
    return scored.orderBy(F.desc("passed"), "max_shared", "seed").limit(1).select("seed", "passed", "max_shared")


def report_search(tasks: DataFrame, key: Column, id_: str, pos: str, body: Column, vectors, seeds: int, n: int = 8, threshold: float = 0.85, issues: DataFrame | None = None, shares: tuple[float, float] = SHARES) -> DataFrame:
    """(seed, passed, max_shared, max_cosine) of every seed's split, rebalanced as in ``grouped_split``.

    Shared n-grams and cosines are of pairs of rows, whatever the split, so they are found once; a seed's are the greatest
    over the pairs of which one row is in its held_out and the other isn't. passed: no shared n-gram, cosine under the
    threshold, and no row in ``issues`` (faults that don't depend on the split). vectors: ``overlap.term_vectors`` or
    ``overlap.hash_vectors``.
    """
    from quern.operators import overlap

    rows = tasks.select(F.col(id_).alias("id"), F.col(pos).alias("pos"), key.alias("key"), body.alias("text"))
    a, b = rows.select(F.col("id").alias("a"), "text"), rows.select(F.col("id").alias("b"), "text")
    grams = overlap.ngram_overlap(a, b, n, "a", "b").where("a < b")
    cosine = overlap.sparse_cosine(vectors(a, "a"), vectors(b, "b"), "a", "b").where("a < b")
    pairs = grams.join(cosine, ["a", "b"], "full").na.fill(0, ["shared"]).na.fill(0.0, ["cosine"])

    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    tried = tasks.sparkSession.range(seeds).select(F.col("id").cast("int").alias("seed"))
    placed = first_fit(tried.crossJoin(groups).withColumn("ord", drawn(F.col("seed"), F.col("key"))), ["seed"], shares).join(rows.select("id", "pos", "key"), "key")
    by = Window.partitionBy("seed")
    count = lambda split: F.count_if(F.col("split") == split).over(by)
    total = F.count("*").over(by)
    need = (F.floor(total * shares[0]) - count("train")) + (F.floor(total * shares[1]) - count("dev"))
    back = F.row_number().over(Window.partitionBy("seed", "split").orderBy(F.desc("ord"), F.desc("key"), F.desc("pos")))
    held = placed.withColumn("need", need).withColumn("back", back).where("split = 'held_out' and back > need")
    # the seeds of which just one row of the pair is held out
    of = held.groupBy("id").agg(F.collect_set("seed").alias("seeds"))
    seeds_of = lambda x: of.select(F.col("id").alias(x), F.col("seeds").alias(f"s_{x}"))
    some = lambda x: F.coalesce(f"s_{x}", F.array().cast("array<int>"))
    crossing = pairs.join(seeds_of("a"), "a", "left").join(seeds_of("b"), "b", "left").withColumn("seed", F.explode(F.array_union(F.array_except(some("a"), some("b")), F.array_except(some("b"), some("a")))))
    worst = crossing.groupBy("seed").agg(F.max("shared").alias("max_shared"), F.max("cosine").alias("max_cosine"))
    out = tried.join(worst, "seed", "left").na.fill(0, ["max_shared"]).na.fill(0.0, ["max_cosine"])
    sound = F.lit(True) if issues is None else F.col("quern_issues") == 0
    if issues is not None:
        out = out.crossJoin(issues.agg(F.count("*").alias("quern_issues")))
    return out.select("seed", ((F.col("max_shared") < 1) & (F.col("max_cosine") < threshold) & sound).alias("passed"), "max_shared", F.round("max_cosine", 6).alias("max_cosine"))


def best_seed(rated: DataFrame) -> DataFrame:
    """The row of the first seed that passed; if none did, of the fewest shared n-grams, then the lowest cosine, then the smallest seed."""
    late = lambda c: F.when(~F.col("passed"), F.col(c))
    return rated.orderBy(F.desc("passed"), late("max_shared"), late("max_cosine"), "seed").limit(1)
