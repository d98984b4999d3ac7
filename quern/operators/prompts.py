"""Prompts and templated outputs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASK = "Please write one short reply that is true to the facts below, respectful and direct."
PARTS = ("hiring_signal_brief", "competitor_gap_brief", "bench_summary", "request_context", "prior_thread")
ONLY_SUBJECT = "Request: 15 minutes on your hiring priorities"
ONLY_BODY = "Hello {company}, open roles went from {roles_60} to {roles_today}, next to a {stage} signal. I can show two options within confirmed capacity. Would you be open to 15 minutes next week?"


def task_prompt(input_: Column, fields: tuple[str, ...]) -> Column:
    """Instruction, outreach type and the task's parts as JSON, a line each; parts that the input doesn't have are left out."""
    lines = [F.lit(ASK), F.concat(F.lit("Outreach type: "), F.coalesce(input_["outreach_type"], F.lit("cold")))]
    lines += [F.concat(F.lit(f"{p}: "), F.coalesce(F.to_json(input_[p]), F.lit("{}"))) for p in PARTS if p in fields]
    return F.concat_ws("\n", *lines)


def revision_prompt(subject: Column, body: Column, outreach: Column, limit: Column, required: Column) -> Column:
    """Asks for a revision of a draft within a word limit, naming the phrases that it should hold."""
    wanted = F.filter(F.transform(required, F.trim), lambda p: p != "")
    named = F.when(F.size(wanted) > 0, F.array_join(wanted, ", ")).otherwise("<none>")
    return F.concat(F.lit("Revise this draft.\nWord limit: "), limit.cast("string"), F.lit("\nPhrases: "), named, F.lit("\nOutreach type: "), outreach, F.lit("\nSubject: "), subject, F.lit("\nBody: "), body)


def prompt_only(company: Column, roles_60: Column, roles_today: Column, stage: Column) -> Column:
    """Struct (subject, body) of the template that uses the facts and no model."""
    s = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    values = {"{company}": s(company, "there"), "{roles_60}": s(roles_60, "N/A"), "{roles_today}": s(roles_today, "N/A"), "{stage}": s(stage, "recent")}
    body = F.lit(ONLY_BODY)
    for k, v in values.items():
        body = F.replace(body, F.lit(k), v)
    return F.struct(F.lit(ONLY_SUBJECT).alias("subject"), body.alias("body"))


def chatml(*turns: tuple[str, Column]) -> Column:
    """Turns of (role, text) in ChatML."""
    return F.concat(*(x for role, c in turns for x in (F.lit(f"<|im_start|>{role}\n"), c, F.lit("<|im_end|>\n"))))
