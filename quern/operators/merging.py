"""Generated results over templates, fields within pairs, and the export of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import posts
from quern.sources import model


def copy_within_pair(df: DataFrame, pair: str, leads: Column, *fields: str) -> DataFrame:
    """df with the fields of each pair's leading row in its other row too; without a leading row they stay. One shuffle by pair."""
    w = Window.partitionBy(pair)
    return df.withColumns({f: F.when(leads, F.col(f)).otherwise(F.coalesce(F.max(F.when(leads, F.col(f))).over(w), F.col(f))) for f in fields})


def usable(made: DataFrame, index: str, parts: list[str]) -> DataFrame:
    """Generated rows whose index is a whole number and whose parts aren't blank; of several with one index the least."""
    whole = F.expr(f"try_cast(`{index}` as bigint)")
    ok = whole.isNotNull()
    for p in parts:
        ok = ok & (F.trim(F.coalesce(p, F.lit(""))) != "")
    return made.where(ok).groupBy(whole.alias(index)).agg(F.min(F.struct(*parts)).alias("quern_made"))


def over_templates(tasks: DataFrame, index: str, made: list[DataFrame], parts: list[str]) -> DataFrame:
    """tasks with each row's parts from the first of ``made`` that has a usable result for it, else its own, the template's."""
    out, found = tasks, []
    for i, m in enumerate(made):
        u = usable(m, index, parts).withColumnRenamed("quern_made", f"quern_made{i}")
        out = out.join(u, index, "left")
        found.append(F.col(f"quern_made{i}"))
    best = F.coalesce(*found)
    return out.withColumns({p: F.coalesce(best[p], F.col(p)) for p in parts}).drop(*(f"quern_made{i}" for i in range(len(made))))


def export(tasks: DataFrame, client: model.Client, batch: int = 10, wait: float = 1.5) -> DataFrame:
    """(task_id, subject, body, generated): the client's answer to each prompt, without the prompt where it is repeated, read as labelled
    sections and cleaned up; a task without an answer has the clean-up of an empty one.

    tasks: task_id, prompt, outreach_type, required (array), stage, roles, fallback.
    """
    said = model.call(tasks, "task_id", "prompt", client, batch, wait=wait).select("task_id", F.coalesce("output", F.lit("")).alias("said"), F.col("success").alias("generated"))
    j = tasks.join(said, "task_id")
    own = F.when(F.startswith("said", "prompt"), F.substring(F.col("said"), F.length("prompt") + 1, F.lit(2147483647))).otherwise(F.col("said"))
    p = j.withColumn("quern_p", text.parse_labelled(own))
    done = posts.postprocess(F.col("quern_p.subject"), F.col("quern_p.body"), F.col("outreach_type"), F.col("required"), F.col("stage"), F.col("roles"), F.col("fallback"))
    return p.select("task_id", done.alias("o"), "generated").select("task_id", "o.subject", "o.body", "generated")
