"""Cleaning of model output: sections, lines, sentences, limits. All folds run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicon, text

MARKERS = tuple("[contact information]|[linkedin|[source url|[your company|[your name]|[your position]|the subject line is|this approach is designed|this response is tailored".split("|"))
ASK_MARKS = tuple(sorted({*lexicon.ASKS} - {"reply with"}))
DEFAULT_ASK = "Would you be open to a 15-minute review next week?"
DEFAULT_SUBJECT = "15 minutes on hiring priorities"


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def clean_body(body: Column) -> Column:
    """Lines without subject lines and notes about the text, 'body:' unwrapped, ended at a sign-off or rule; blank if no text."""
    lines = F.filter(F.transform(F.split(body, "\r\n|\r|\n"), text.strip), lambda s: s != "")
    lines = F.filter(lines, lambda s: ~F.startswith(F.lower(s), F.lit("subject:")))
    lines = F.transform(lines, lambda s: F.when(F.startswith(F.lower(s), F.lit("body:")), text.strip(F.substring(s, 6, 2147483647))).otherwise(s))
    return _let(lines, lambda x: _without_notes(x, body))


def _without_notes(lines: Column, body: Column) -> Column:
    ends = F.transform(lines, lambda s: text.starts_with_any(F.lower(s), ("best regards", "regards,", "sincerely")) | F.startswith(s, F.lit("---")))
    stop = F.array_position(ends, True)
    lines = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    lines = F.filter(lines, lambda s: ~_any(F.lower(s), MARKERS))
    return _let(lines, lambda x: _joined(x, body))


def _joined(lines: Column, body: Column) -> Column:
    return F.coalesce(text.squeeze(F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(body)), F.lit(""))


def require_phrase(body: Column, required: Column, stage: Column, roles: Column) -> Column:
    """body, with a grounding sentence appended where no required phrase occurs in it."""
    wanted = F.filter(F.transform(required, text.strip), lambda p: p != "")
    has = F.exists(wanted, lambda p: F.contains(F.lower(body), F.lower(p)))
    add = F.concat(F.lit(" I noticed a "), F.regexp_replace(F.coalesce(stage, F.lit("recent signal")), "_", " "), F.lit(" signal and "), F.coalesce(roles.cast("string"), F.lit("N/A")), F.lit(" open roles."))
    return F.when((F.size(wanted) <= 0) | F.coalesce(has, F.lit(True)), body).otherwise(text.strip(F.concat(body, add)))


def single_cta(body: Column) -> Column:
    """Only the first asking sentence stays; a default one is added where there is none."""
    start = F.struct(F.lit(False).alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        ask = F.contains(x, F.lit("?")) | _any(F.lower(x), ASK_MARKS)
        return F.struct((s["seen"] | ask).alias("seen"), F.when(ask & s["seen"], s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept"))

    return F.aggregate(text.sentences(body), start, step, lambda s: text.strip(F.array_join(F.when(s["seen"], s["kept"]).otherwise(F.concat(s["kept"], F.array(F.lit(DEFAULT_ASK)))), " ")))


def trim_words(body: Column, outreach: Column) -> Column:
    limit = F.lit(lexicon.DEFAULT_LIMIT)
    for k, v in lexicon.WORD_LIMITS.items():
        limit = F.when(outreach == k, v).otherwise(limit)
    return _let(text.words(body), lambda w: _cut(w, body, limit))


def _cut(w: Column, body: Column, limit: Column) -> Column:
    return F.when(F.size(w) <= limit, body).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(w, F.lit(1), limit), " "), "[ ,;:-]+$", ""), F.lit(".")))


def normalize_subject(subject: Column) -> Column:
    s = text.squeeze(F.coalesce(subject, F.lit("")))
    s = F.when(F.startswith(F.lower(s), F.lit("subject:")), text.squeeze(F.substring(s, 9, 2147483647))).otherwise(s)
    s = F.when(s == "", DEFAULT_SUBJECT).otherwise(s)
    s = F.regexp_replace(s, r"""^[\[\](){}"' ]+|[\[\](){}"' ]+$""", "")
    s = F.when(F.startswith(F.lower(s), F.lit("request:")), s).otherwise(F.concat(F.lit("Request: "), s))
    return F.when(F.length(s) > 60, f"Request: {DEFAULT_SUBJECT}").otherwise(s)


def postprocess(subject: Column, body: Column, outreach: Column, required: Column, stage: Column, roles: Column, fallback: Column) -> Column:
    """Struct (subject, body) after all steps in order; an empty body becomes the fallback."""
    kind = F.lower(F.coalesce(outreach, F.lit("cold")))
    grounded = _let(clean_body(body), lambda b: require_phrase(b, required, stage, roles))
    trimmed = _let(_let(grounded, single_cta), lambda b: text.squeeze(trim_words(b, kind)))
    return F.struct(normalize_subject(subject).alias("subject"), _let(trimmed, lambda b: F.when(b == "", fallback).otherwise(b)).alias("body"))
