"""Judging, pairing, quotas, de-duplication by key, ids and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.safe import clamp, family, safe_text

SCORES = ("input_coherence", "ground_truth_verifiability", "rubric_application_clarity")


def judge(tasks: DataFrame, responses: DataFrame, judge_model: str, min_score: int = 4) -> DataFrame:
    """Decisions of a judge: accept if all three scores reach the threshold and judge and generator differ in family.

    tasks (task_id, generator_model); responses (task_id, three scores as text). A missing response or score counts 1; one that can't be
    read makes all three 1. Scores and the threshold are held to 1 to 5.
    """
    least = max(1, min(5, min_score))
    j = tasks.select("task_id", "generator_model").join(responses.select("task_id", *SCORES), "task_id", "left")
    broken = F.lit(False)
    for s in SCORES:
        broken = broken | (F.col(s).isNotNull() & F.col(s).try_cast("int").isNull())
    j = j.withColumn("broken", broken).withColumns({s: F.when(F.col("broken"), 1).otherwise(clamp(F.coalesce(F.col(s).try_cast("int"), F.lit(1)))) for s in SCORES})
    ok = family(F.col("generator_model")) != family(F.lit(judge_model))
    return j.select("task_id", "generator_model", family(F.col("generator_model")).alias("generator_family"), family(F.lit(judge_model)).alias("judge_family"), ok.alias("no_leakage_ok"), *SCORES, F.when((F.least(*SCORES) >= least) & ok, "accept").otherwise("reject").alias("decision"))


def pair_winner(id_a: Column, body_a: Column, id_b: Column, body_b: Column, named: Column | None = None) -> Column:
    """The named winner if it is one of the two; else the one with the longer body, ties to a."""
    longer = F.when(F.length(safe_text(body_a)) >= F.length(safe_text(body_b)), id_a).otherwise(id_b)
    return longer if named is None else F.when((named == id_a) | (named == id_b), named).otherwise(longer)


def pick_winner(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id_a, id_b, winner): of the decisions whose winner is in the pair the first; a where there is none."""
    first = decisions.groupBy("winner").agg(F.min("pos").alias("pos"))
    ends = pairs.select("id_a", "id_b", F.explode(F.array("id_a", "id_b")).alias("winner"))
    found = ends.join(first, "winner", "left").groupBy("id_a", "id_b").agg(F.min_by("winner", "pos").alias("winner"))
    return found.withColumn("winner", F.coalesce("winner", "id_a"))


def accept_quota(df: DataFrame, by: str, pos: str, targets: Column) -> DataFrame:
    """The first rows of each group in order of pos, up to the group's target."""
    return df.withColumn("quern_rn", F.row_number().over(Window.partitionBy(by).orderBy(pos))).where(F.col("quern_rn") <= targets).drop("quern_rn")


def dedupe(df: DataFrame, key: str, pos: str, last: bool = False, dropped: str | None = None) -> DataFrame:
    """One row a key, the first (or last) by pos; keys are trimmed, null and blank ones dropped.

    dropped: name of a column for the number of rows of the key that went.
    """
    k = F.trim(F.col(key).cast("string"))
    order = F.desc(pos) if last else F.asc(pos)
    out = df.where(k.isNotNull() & (k != "")).withColumn("quern_rn", F.row_number().over(Window.partitionBy(k).orderBy(order)))
    if dropped:
        out = out.withColumn(dropped, F.count("*").over(Window.partitionBy(k)) - 1)
    return out.where("quern_rn = 1").drop("quern_rn")


def lookup(df: DataFrame, outputs: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """df with columns of outputs by key, defaults where there is none."""
    got = df.join(outputs.select(F.col(key), *(F.col(c).alias(f"quern_{c}") for c in defaults)), key, "left")
    return got.withColumns({c: F.coalesce(f"quern_{c}", d) for c, d in defaults.items()}).drop(*(f"quern_{c}" for c in defaults))


def require_all(df: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inner join by key; ValueError if a key of df has no output."""
    if df.join(outputs.select(key), key, "left_anti").limit(1).count():
        raise ValueError(f"rows without an output for their {key}")
    return df.join(outputs, key)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_filled(df: DataFrame, *names: str) -> DataFrame:
    """df; ValueError if one of the columns is missing or holds a null."""
    nulls = require_columns(df, *names).agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"nulls in {', '.join(f'{n} ({k})' for n, k in nulls.items() if k)}")
    return df


def require_other_family(generators: list[str], judge_model: str) -> None:
    """ValueError if a generator is of the judge's family."""
    of = lambda m: m.split("/")[0].lower()
    same = [g for g in generators if of(g) == of(judge_model)]
    if same:
        raise ValueError(f"of the family of judge {judge_model}: {', '.join(same)}")


def head(df: DataFrame, pos: str, n: int) -> DataFrame:
    """The first n rows in order of pos: the limit that a caller sets, before or after the work."""
    return df.orderBy(pos).limit(n)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by sha256 of seed and key."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def chunks(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(pos) / size))


def ordinal_ids(df: DataFrame, mode: str, pos: str, lpad: bool = False) -> DataFrame:
    """df with task_id: the mode's first three letters and its number within the mode, of five digits at least; null for a null mode.

    ``lpad`` takes five digits at most, as that function does in SQL: from the 100,000th row of a mode on, ids repeat.
    """
    n = F.row_number().over(Window.partitionBy(mode).orderBy(F.asc_nulls_last(pos)))
    digits = F.lpad(n.cast("string"), 5, "0") if lpad else F.format_string("%05d", n)
    return df.withColumn("task_id", F.concat(F.upper(F.substring(mode, 1, 3)), F.lit("-"), digits))


def failure_streaks(df: DataFrame, by: list[str], pos: str, success: Column) -> DataFrame:
    """df with streak: failures in a row up to and including this row; 0 on success. Islands by a running count of successes."""
    ok = F.coalesce(success, F.lit(False)).cast("int")
    w = Window.partitionBy(*by).orderBy(pos)
    d = df.withColumn("quern_ok", ok).withColumn("quern_island", F.sum("quern_ok").over(w))
    return d.withColumn("streak", F.sum(1 - F.col("quern_ok")).over(Window.partitionBy(*by, "quern_island").orderBy(pos))).drop("quern_ok", "quern_island")


def stop_after(df: DataFrame, by: list[str], pos: str, success: Column, limit: int) -> DataFrame:
    """Rows up to and including the first that completes a streak of ``limit`` failures."""
    s = failure_streaks(df, by, pos, success)
    hit = F.sum((F.col("streak") >= limit).cast("int")).over(Window.partitionBy(*by).orderBy(pos))
    return s.withColumn("quern_hit", hit).where("quern_hit = 0 or (quern_hit = 1 and streak >= " + str(limit) + ")").drop("quern_hit")


def cost_rollup(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls (success, cost, prompt_tokens, completion_tokens) by group; nulls count 0, known cost only over successes that have one."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(~ok).alias("failed"), s("prompt_tokens").alias("tokens_in"), s("completion_tokens").alias("tokens_out"), F.round(F.coalesce(F.sum(F.when(ok, F.col("cost"))), F.lit(0.0)), 6).alias("cost"), F.count_if(ok & F.col("cost").isNull()).alias("unknown_cost"))


def call_cost(usage_cost: Column, total_cost: Column, top_cost: Column) -> Column:
    return F.coalesce(usage_cost, total_cost, top_cost)


def agreement(df: DataFrame, a: dict[str, Column], b: dict[str, Column]) -> DataFrame:
    """(marker, agreement_pct) of two raters' booleans, and a row 'overall'."""
    names = list(a)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("marker"), (a[m] == b[m]).cast("int").alias("same")) for m in names))).alias("x")).select("x.*")
    return long.rollup("marker").agg(F.round(F.avg("same") * 100, 2).alias("agreement_pct")).select(F.coalesce("marker", F.lit("overall")).alias("marker"), "agreement_pct")
