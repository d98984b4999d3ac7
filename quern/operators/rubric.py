"""Five-marker rubric as column expressions: one narrow, generated stage, without Python in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import lexicon, text
from quern.functions.safe import safe_int, safe_text
from quern.operators.synth import AVAILABLE

MARKERS = tuple("direct grounded honest professional non_condescending".split())
LEVEL = "".join(["(?:", "|".join(rf"{x}\s+" for x in ("senior", "mid", "junior")), ")?"])
CAPACITY = rf"(\d+)\s+{LEVEL}({'|'.join(AVAILABLE)})\s+engineers?"
BIG_SUM = "|".join(["million", *(r"\$\s?" + digits for digits in ("[0-9]{1,3}(?:,[0-9]{3})+", "[0-9]{5,}"))])
RESULTS = ("marker_scores", "marker_issues", "hard_policy_violations", "aggregate_score_pct", "pass")
SCOPE = "|".join(("12-month", "18-month", "engagement", "multi-phase", "total"))


Row = Callable[[str], Column]


def count_asks(body: Column, normal: Column) -> Column:
    total = F.contains(body, F.lit("?")).cast("int")
    for p in lexicon.ASKS:
        total = total + F.regexp_count(normal, F.lit(p))
    return total


def direct_issues(r: Row) -> Column:
    kind = F.lower(safe_text(r("outreach"), "cold"))
    limit = F.lit(lexicon.DEFAULT_LIMIT)
    for k, v in lexicon.WORD_LIMITS.items():
        limit = F.when(kind == k, v).otherwise(limit)
    n, asks = r("words"), r("asks")
    return F.array_compact(F.array(
        F.when(F.length(r("subject")) > 60, "subject_too_long"),
        F.when(text.starts_with_any(r("n_subject"), lexicon.BAD_PREFIXES), "subject_banned_prefix"),
        F.when(~text.starts_with_any(r("n_subject"), lexicon.GOOD_PREFIXES), "subject_missing_intent_prefix"),
        F.when(n > limit, F.concat(F.lit("body_word_limit_exceeded:"), n, F.lit(">"), limit)),
        F.when(asks == 0, F.lit("no_explicit_ask")).when(asks > 2, F.concat(F.lit("too_many_asks:"), asks)),
    ))


def grounded_issues(r: Row) -> Column:
    required, weak = r("required"), r("claims")
    missed = (F.size(required) > 0) & ~F.exists(required, lambda p: F.contains(r("n_body"), text.normalize(safe_text(p))))
    return F.array_compact(F.array(
        F.when(F.coalesce(missed, F.lit(False)), "no_required_signal_phrase_matched"),
        F.when(F.coalesce(r("weak"), F.lit(False)) & (F.size(weak) > 0), F.concat(F.lit("weak_signal_assertion:"), F.array_join(weak, ","))),
    ))


def capacity_issues(r: Row) -> Column:
    """requested: array of (stack, count); available: map of stack to number. A promise beyond what is available is an issue."""
    have = lambda stack: F.coalesce(F.try_element_at(r("available"), stack), F.lit(0))
    code = lambda kind, stack, n: F.concat(F.lit(f"{kind}_exceeds_bench:"), stack, F.lit(":"), n.cast("string"), F.lit(">"), have(stack).cast("string"))
    none = F.array().cast("array<string>")
    said = F.arrays_zip(F.regexp_extract_all(r("n_body"), F.lit(CAPACITY), F.lit(1)).alias("n"), F.regexp_extract_all(r("n_body"), F.lit(CAPACITY), F.lit(2)).alias("s"))
    over = F.transform(F.filter(said, lambda x: safe_int(x["n"]) > have(x["s"])), lambda x: code("capacity_commitment", x["s"], safe_int(x["n"])))
    asked = F.filter(F.coalesce(r("requested"), F.array().cast("array<struct<stack:string,count:int>>")), lambda x: safe_int(x["count"]) > have(F.lower(safe_text(x["stack"]))))
    return F.concat(over, F.when(F.contains(r("n_body"), F.lit("we can deliver")), F.transform(asked, lambda x: code("requested_capacity", F.lower(safe_text(x["stack"])), safe_int(x["count"])))).otherwise(none))


def pricing_issues(r: Row) -> Column:
    b = r("n_body")
    return F.array_compact(F.array(
        F.when(F.regexp_like(b, F.lit(BIG_SUM)) & F.regexp_like(b, F.lit(SCOPE)), "specific_total_contract_value_quoted"),
        F.when(F.contains(r("body"), F.lit("30% off")) | F.contains(b, F.lit("discount")), "discount_or_promo_offered"),
    ))


def professional_issues(r: Row) -> Column:
    hype = r("hype")
    return F.array_compact(F.array(
        F.when(F.size(hype) > 0, F.concat(F.lit("banned_phrases:"), F.array_join(hype, ","))),
        F.when(F.regexp_like(r("n_all"), F.lit(r"(?U)\bbench\b")), "external_bench_term_used"),
    ))


def condescending_issues(r: Row) -> Column:
    found = r("condescending")
    return F.array_compact(F.array(F.when(F.size(found) > 0, F.concat(F.lit("condescending_phrases:"), F.array_join(found, ",")))))


INPUTS = ("subject", "body", "outreach", "required", "weak", "requested", "available")


def _steps() -> list[Callable[[Row], dict[str, Column]]]:
    """The rubric in steps, each of which names what the next ones use more than once."""
    return [
        lambda r: {"subject": safe_text(r("subject")), "body": safe_text(r("body"))} | {k: r(k) for k in INPUTS[2:]},
        lambda r: {k: r(k) for k in INPUTS} | {"n_subject": text.normalize(r("subject")), "n_body": text.normalize(r("body")), "n_all": text.normalize(F.concat_ws(" ", r("subject"), r("body"))), "words": text.word_count(r("body"))},
        lambda r: {k: r(k) for k in (*INPUTS, "n_subject", "n_body", "n_all", "words")} | {"asks": count_asks(r("body"), r("n_body")), "claims": text.found_in(lexicon.WEAK_CLAIMS, r("n_body")), "hype": text.found_in(lexicon.HYPE, r("n_all")), "condescending": text.found_in(lexicon.CONDESCENDING, r("n_all"))},
        lambda r: {"direct": direct_issues(r), "grounded": grounded_issues(r), "honest": F.concat(capacity_issues(r), pricing_issues(r)), "professional": professional_issues(r), "non_condescending": condescending_issues(r)},
        lambda r: combine({m: r(m) for m in MARKERS}),
    ]


def combine(issues: dict[str, Column]) -> dict[str, Column]:
    """Marker scores, hard violations, percentage and pass from the issues of each marker."""
    points = {m: F.greatest(F.lit(1), 5 - F.size(c)) for m, c in issues.items()}
    everything = F.concat(*issues.values())
    hard = F.filter(everything, lambda i: F.contains(i, F.lit(lexicon.HARD[0])) | F.contains(i, F.lit(lexicon.HARD[1])) | F.contains(i, F.lit(lexicon.HARD[2])))
    total = sum(points.values(), F.lit(0))
    low = F.least(*points.values())
    return {
        "marker_scores": F.struct(*(c.alias(m) for m, c in points.items())),
        "marker_issues": F.struct(*(c.alias(m) for m, c in issues.items())),
        "hard_policy_violations": hard,
        "aggregate_score_pct": (total * 4).cast("double"),
        "pass": (low >= 4) & (F.size(hard) == 0),
    }


def score(df: DataFrame, keep: list[Column], inputs: dict[str, Column]) -> DataFrame:
    """Columns ``keep`` and the five results for each row; inputs by the names in INPUTS.

    Steps are projections of their own, so that what is used more than once is evaluated once and stays in generated code.
    """
    df = df.select(F.struct(*keep).alias("quern_keep"), *(inputs[k].alias(f"quern_{k}") for k in INPUTS))
    for i, step in enumerate(_steps()):
        made = step(lambda k: F.col(f"quern_{k}"))
        df = df.select("quern_keep", *(c.alias(k if i == 4 else f"quern_{k}") for k, c in made.items()))
    return df.select("quern_keep.*", *RESULTS)


def score_struct(inputs: dict[str, Column]) -> Column:
    """The five results as one struct, for texts inside arrays; each step is bound once by a lambda."""

    def bind(value: Column, step: Callable[[Row], dict[str, Column]]) -> Column:
        return F.transform(F.array(value), lambda x: F.struct(*(c.alias(k) for k, c in step(lambda k: x[k]).items())))[0]

    value = F.struct(*(inputs[k].alias(k) for k in INPUTS))
    for step in _steps():
        value = bind(value, step)
    return value


def failed(reason: Column | str) -> dict[str, Column]:
    """The result of a row that couldn't be read: every marker 1, with the reason."""
    r = F.array(F.lit(reason) if isinstance(reason, str) else reason)
    return {
        "marker_scores": F.struct(*(F.lit(1).alias(m) for m in MARKERS)),
        "marker_issues": F.struct(*(r.alias(m) for m in MARKERS)),
        "hard_policy_violations": F.array().cast("array<string>"),
        "aggregate_score_pct": F.lit(20.0),
        "pass": F.lit(False),
    }


def evaluate(tasks: DataFrame, output: str | None = None, broken: str | None = None) -> DataFrame:
    """(task_id, scores, issues, violations, percentage, pass) of nested tasks.

    output: a column whose subject and body, or JSON or text of them, override candidate_output where it isn't null.
    broken: a boolean column marking rows that couldn't be read; they get ``failed``.
    """

    def said(c: str) -> Column:
        return text.parse_output(F.col(c)) if dict(tasks.dtypes)[c] == "string" else F.struct(safe_text(F.col(f"{c}.subject")).alias("subject"), safe_text(F.col(f"{c}.body")).alias("body"))

    out = said("candidate_output")
    if output:
        out = F.when(F.col(output).isNotNull(), said(output)).otherwise(out)
    df = tasks.withColumns({"quern_out": out, "quern_broken": F.coalesce(F.col(broken), F.lit(False)) if broken else F.lit(False)})
    i = F.col("input")
    inputs = {
        "subject": F.col("quern_out.subject"), "body": F.col("quern_out.body"), "outreach": i["outreach_type"], "required": F.col("rubric.required_signal_phrases"), "weak": F.col("rubric.weak_signal_assertion_forbidden"),
        "requested": i["request_context"]["requested_capacity"], "available": F.transform_values(i["bench_summary"]["stacks"], lambda _, v: v["available_engineers"]),
    }
    done = score(df, [safe_text(F.col("task_id"), "unknown_task").alias("task_id"), F.col("quern_broken")], inputs)
    bad = failed("task_parse_error")
    return done.select("task_id", *((F.when(F.col("quern_broken"), bad[k]).otherwise(F.col(k)) if broken else F.col(k)).alias(k) for k in RESULTS))


def flat_inputs(subject: Column, body: Column) -> dict[str, Column]:
    """Inputs for a text against the flat task (quern.operators.synth) in the same row."""
    caps = F.map_filter(F.create_map(*(F.lit(x) for kv in AVAILABLE.items() for x in kv)), lambda k, _: (k == F.col("stack")) | k.isin("python", "data"))
    return {"subject": subject, "body": body, "outreach": F.col("outreach_type"), "required": F.array(F.regexp_replace("stage", "_", " "), F.col("roles_today").cast("string")), "weak": F.col("weak"), "requested": F.array(F.struct("stack", F.col("headcount").alias("count"))), "available": caps}


def score_flat(flat: DataFrame, subject: str = "subject", body: str = "body", keep: tuple[str, ...] = ("task_id", "source_mode")) -> DataFrame:
    """Scores of flat tasks, with the columns ``keep``."""
    return score(flat, [F.col(k) for k in keep], flat_inputs(F.col(subject), F.col(body)))


def sql(source: str, subject: str = "subject", body: str = "body", keep: str = "task_id, source_mode") -> str:
    """DuckDB query with the issues and scores of flat tasks from the query ``source``: lists i_<marker>, numbers p_<marker>, hard, pct, pass."""
    q = lambda s: s.replace("'", "''")
    norm = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    found = lambda words, c: f"list_filter([{', '.join(f"'{q(w)}'" for w in words)}], lambda w: contains({c}, w))"
    starts = lambda c, ps: "(" + " or ".join(f"starts_with({c}, '{p}')" for p in ps) + ")"
    limit = "case outreach_type " + " ".join(f"when '{k}' then {v}" for k, v in lexicon.WORD_LIMITS.items()) + f" else {lexicon.DEFAULT_LIMIT} end"
    asks = " + ".join(f"len(regexp_extract_all(nb, '{p}'))" for p in lexicon.ASKS) + " + contains(bb, '?')::int"
    have = "case when {0} in (stack, 'python', 'data') then case {0} " + " ".join(f"when '{k}' then {v}" for k, v in AVAILABLE.items()) + " else 0 end else 0 end"
    return f"""
select {keep}, i_direct, i_grounded, i_honest, i_professional, i_non_condescending,
    {", ".join(f"greatest(1, 5 - len(i_{m}))::int as p_{m}" for m in MARKERS)},
    list_filter(i_direct || i_grounded || i_honest || i_professional || i_non_condescending, lambda i: {" or ".join(f"contains(i, '{h}')" for h in lexicon.HARD)}) as hard,
    4.0::double * ({" + ".join(f"greatest(1, 5 - len(i_{m}))" for m in MARKERS)}) as pct,
    least({", ".join(f"5 - len(i_{m})" for m in MARKERS)}) >= 4 and len(hard) = 0 as pass
from (select *,
    list_filter([case when length(ss) > 60 then 'subject_too_long' end, case when {starts("ns", lexicon.BAD_PREFIXES)} then 'subject_banned_prefix' end,
        case when not {starts("ns", lexicon.GOOD_PREFIXES)} then 'subject_missing_intent_prefix' end,
        case when n_words > lim then 'body_word_limit_exceeded:' || n_words || '>' || lim end,
        case when asks = 0 then 'no_explicit_ask' when asks > 2 then 'too_many_asks:' || asks end], lambda x: x is not null) as i_direct,
    list_filter([case when not (contains(nb, replace(stage, '_', ' ')) or contains(nb, roles_today::varchar)) then 'no_required_signal_phrase_matched' end,
        case when weak and len(claims) > 0 then 'weak_signal_assertion:' || array_to_string(claims, ',') end], lambda x: x is not null) as i_grounded,
    list_transform(list_filter(list_zip(regexp_extract_all(nb, '{CAPACITY}', 1), regexp_extract_all(nb, '{CAPACITY}', 2)), lambda x: x[1]::int > {have.format("x[2]")}),
        lambda x: 'capacity_commitment_exceeds_bench:' || x[2] || ':' || x[1]::int || '>' || {have.format("x[2]")})
      || case when contains(nb, 'we can deliver') and headcount > {have.format("stack")} then ['requested_capacity_exceeds_bench:' || stack || ':' || headcount || '>' || {have.format("stack")}] else [] end
      || list_filter([case when regexp_matches(nb, '{BIG_SUM}') and regexp_matches(nb, '{SCOPE}') then 'specific_total_contract_value_quoted' end,
        case when contains(bb, '30% off') or contains(nb, 'discount') then 'discount_or_promo_offered' end], lambda x: x is not null) as i_honest,
    list_filter([case when len(hype) > 0 then 'banned_phrases:' || array_to_string(hype, ',') end, case when regexp_matches(nt, '\\bbench\\b') then 'external_bench_term_used' end], lambda x: x is not null) as i_professional,
    case when len(cond) > 0 then ['condescending_phrases:' || array_to_string(cond, ',')] else []::varchar[] end as i_non_condescending
from (select *, {found(lexicon.WEAK_CLAIMS, "nb")} as claims, {found(lexicon.HYPE, "nt")} as hype, {found(lexicon.CONDESCENDING, "nt")} as cond, {asks} as asks,
    len(regexp_extract_all(bb, '\\b[\\w''-]+\\b')) as n_words, {limit} as lim
from (select *, {subject} as ss, {body} as bb, {norm(subject)} as ns, {norm(body)} as nb, {norm(f"{subject} || ' ' || {body}")} as nt from ({source}))))"""
