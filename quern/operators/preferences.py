"""Preference pairs: a better and a worse text for each task, the better one always scoring higher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import rubric

TAILS = {
    "BEN": " We can surely deliver 12 go engineers by Monday, at 30% off.",
    "TON": " Frankly, you are falling behind and must catch up.",
    "SIG": " All of this is certain, whatever the evidence says.",
    "SCH": " I went ahead and booked your calendar.",
    "MTL": " Quick question: can we, can we, can we talk?",
}
PENALTIES = (" Any headcount is guaranteed, no matter who is free.", " No signal needs checking, the result is certain.", " You are behind the curve, act before it is too late.", " Sign by Friday and a 30% discount applies.")
WORST = "Subject: Quick chat, urgent\nBody: Any team is guaranteed at once with a 30% discount. You are falling behind and should catch up."


def failure_family(issues: Column, prompt: Column) -> Column:
    """First rule that matches, of commercial, tone, signal, scheduling; else 'MTL'. issues: array of codes."""
    j, p = F.lower(F.array_join(issues, " ")), F.lower(prompt)
    has = lambda c, *words: F.regexp_like(c, F.lit("|".join(words)))
    return (
        F.when(has(j, "capacity_commitment", "specific_total_contract_value", "discount", "pricing"), "BEN")
        .when(has(j, "banned_phrases", "condescending", "external_bench_term"), "TON")
        .when(has(j, "required_signal", "weak_signal_assertion"), "SIG")
        .when(has(p, "schedule", "slots", "calendar", "book"), "SCH")
        .otherwise("MTL")
    )


def repair(company: Column, roles_60: Column, roles_today: Column, stage: Column, closed_at: Column) -> Column:
    s = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    body = F.concat(F.lit("Hello "), s(company, "there"), F.lit(", open roles went from "), s(roles_60, "N/A"), F.lit(" to "), s(roles_today, "N/A"), F.lit(", after a "), s(stage, "recent"), F.lit(" event of "), s(closed_at, "late"), F.lit(". I can share two options within confirmed capacity. Would you be open to 15 minutes next week?"))
    return text.render(F.lit("Request: 15 minutes on your hiring plan"), body)


def degrade(chosen: Column, family: Column) -> Column:
    tail = F.lit(TAILS["MTL"])
    for k, v in TAILS.items():
        tail = F.when(family == k, v).otherwise(tail)
    return F.concat(chosen, tail)


def _mark(rendered: Column) -> Column:
    """Struct (text, score, pass, issues) of a rendered text for the flat task in the same row."""
    said = text.parse_rendered(rendered)
    r = rubric.score_struct(rubric.flat_inputs(said["subject"], said["body"]))
    return F.transform(F.array(r), lambda x: F.struct(rendered.alias("text"), x["aggregate_score_pct"].alias("score"), x["pass"].alias("pass"), F.flatten(F.array(*(x["marker_issues"][m] for m in rubric.MARKERS))).alias("issues")))[0]


def pairs(flat: DataFrame) -> DataFrame:
    """(task_id, source_mode, family, chosen, rejected, chosen_score, rejected_score) of flat tasks (quern.operators.synth).

    A passing text is chosen, its degraded form rejected; a failing one is rejected, a repaired text chosen. While the
    rejected one doesn't score lower, penalties are added to it one by one; at last both are replaced. Candidates are
    arrays, scored by one expression each: a narrow stage without loops over rows.
    """
    base = flat.withColumns({"given": _mark(text.render(F.col("subject"), F.col("body"))), "fixed": repair(*map(F.col, ("company", "roles_60", "roles_today", "stage", "closed_at")))})
    base = base.withColumn("family", failure_family(F.col("given.issues"), F.concat_ws(" ", "outreach_type", "company", "stack", "pricing_request")))
    texts = F.array(F.col("fixed"), degrade(F.col("given.text"), F.col("family")), degrade(F.col("fixed"), F.col("family")), F.lit(WORST))
    base = base.withColumn("m", F.transform(texts, _mark))
    fixed, worse, worse_fixed, worst = (F.col("m")[i] for i in range(4))
    good = F.col("given.pass")
    base = base.withColumn("chosen", F.when(good, F.col("given")).otherwise(fixed))
    first = F.when(good, worse).otherwise(F.col("given"))
    again = F.when(first["pass"], F.when(good, worse).otherwise(worse_fixed)).otherwise(first)
    base = base.withColumn("rejected", again)
    longer = F.array(*(F.concat(F.col("rejected.text"), F.lit("".join(PENALTIES[: k + 1]))) for k in range(len(PENALTIES))))
    lower = F.filter(F.concat(F.array("rejected"), F.transform(longer, _mark)), lambda x: x["score"] < F.col("chosen.score"))
    base = base.withColumn("found", F.try_element_at(lower, F.lit(1)))
    ok = F.col("found").isNotNull()
    return base.select("task_id", "source_mode", "family", F.when(ok, F.col("chosen.text")).otherwise(fixed["text"]).alias("chosen"), F.when(ok, F.col("found.text")).otherwise(worst["text"]).alias("rejected"), F.when(ok, F.col("chosen.score")).otherwise(fixed["score"]).alias("chosen_score"), F.when(ok, F.col("found.score")).otherwise(worst["score"]).alias("rejected_score"))


def violations(p: DataFrame) -> DataFrame:
    """(family, rows, violations): pairs whose chosen text doesn't score higher."""
    return p.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("chosen_score") <= F.col("rejected_score")).alias("violations"))
