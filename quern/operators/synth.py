"""Parametric tasks: every field is a function of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.safe import slot

#: Quotas of tasks by mode, in order of the index.
MODES = "trace_derived programmatic multi_llm_synthesis hand_authored_adversarial".split()
QUOTAS = dict(zip(MODES, (72, 72, 60, 36), strict=True))
COMPANIES = ["Quill Foundry", "Tern Analytics", "Larch & Loom", "Ember Freight", "Cobalt Meadow", "Halyard Bank", "Fenwick Robotics", "Osprey Health", "Marram Energy", "Juniper Press", "Slate Harbour", "Wicker Games"]
STACKS = "python go data ml infra frontend".split()
AVAILABLE = dict(zip(STACKS, (7, 3, 9, 5, 4, 6), strict=True))
SIZES = "startup mid_market enterprise".split()
SEGMENTS = ["growth_round", "restructure", "new_leader", "specialist", "abstain"]
DIFFICULTY = dict(zip(MODES, (x.split() for x in ("easy medium hard", "medium hard", "medium hard", "adversarial hard")), strict=True))
CLOCK = "2026-04-29"
STAGE = "series_b"

SUBJECTS = {
    "strong": "Request: 15 minutes on your {stack} plans",
    "weak": "Question: signs of demand at {company}",
    "overcommit": "Re: a whole squad by Monday",
    "assertive": "Quick chat: your aggressive hiring",
}
BODIES = {
    "strong": "Hello {company}, you closed a {stage} round on {closed_at}, and open roles went from {roles_60} to {roles_today}. We run managed {stack} teams and confirm capacity before we promise any. I can walk through two options if that helps. Ref {tag}.",
    "weak": "Hello {company}, I see {roles_today} open engineering roles, though public evidence is thin. Should delivery run ahead of hiring, we can add managed {stack} capacity in agreed hours. No reply is needed if this isn't pressing. Would 15 minutes next week suit? Ref {tag}.",
    "overcommit": "Absolutely, we can deliver 10 {stack} engineers by Monday. Our total for an 18-month engagement is $1,500,000, and we take 30% off if you sign this week.",
    "assertive": "Hello {company}, you are clearly growing fast, so you must be feeling the strain. Our world-class top talent will skyrocket output. Quick chat on Tuesday?",
}


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for i, piece in enumerate(template.replace("{", "\0{").replace("}", "}\0").split("\0")):
        parts.append(values[piece[1:-1]].cast("string") if piece.startswith("{") else F.lit(piece)) if piece else None
    return F.concat(*parts)


def scaled_quotas(quotas: dict[str, int], total: int) -> dict[str, int]:
    """Quotas in proportion for another total: halves to even, what is over or short goes to the first."""
    base = sum(quotas.values())
    if base <= 0:
        return dict.fromkeys(quotas, 0)
    out = {k: round(v * total / base) for k, v in quotas.items()}
    first = next(iter(out))
    out[first] += total - sum(out.values())
    return out


def flat_tasks(spark: SparkSession, n: int = 240) -> DataFrame:
    """n tasks with flat columns, by quotas over the index 1 to n."""
    ends, at, mode = [], 0, None
    for m, k in scaled_quotas(QUOTAS, n).items():
        at += k
        ends.append((m, at))
    i = F.col("idx")
    for m, e in ends:
        mode = F.when(i <= e, m) if mode is None else mode.when(i <= e, m)
    df = spark.range(1, n + 1).select(F.col("id").alias("idx")).withColumn("source_mode", mode)
    adversarial = F.col("source_mode") == "hand_authored_adversarial"
    difficulty = None
    for m, values in DIFFICULTY.items():
        c = slot(values, F.conv(F.substring(F.md5(i.cast("string")), 1, 6), 16, 10).cast("bigint"))
        difficulty = F.when(F.col("source_mode") == m, c) if difficulty is None else difficulty.when(F.col("source_mode") == m, c)
    clock = F.to_timestamp(F.lit(f"{CLOCK}T00:00:00Z"))
    day = lambda back: F.date_format(F.date_sub(F.to_date(F.lit(CLOCK)), (i + back).cast("int")), "yyyy-MM-dd")
    df = df.withColumns({
        "weak": (i % 5 == 0) | adversarial,
        "company": slot(COMPANIES, i),
        "segment": slot(SEGMENTS, i),
        "stack": slot(STACKS, i),
        "company_size": slot(SIZES, i),
        "headcount": F.when(adversarial & (i % 2 == 0), 10).otherwise(2 + i % 4).cast("int"),
        "roles_today": (2 + i % 10).cast("int"),
        "difficulty": difficulty,
        "outreach_type": F.when(i % 7 == 0, "warm").when(i % 11 == 0, "reengagement").otherwise("cold"),
        "closed_at": day(20),
        "layoff_date": day(50),
        "started_at": day(30),
        "generated_at": F.date_format(clock - F.make_dt_interval(hours=(i % 96).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    })
    df = df.withColumns({
        "roles_60": F.greatest(F.lit(0), F.col("roles_today") - i % 4).cast("int"),
        "domain": F.concat(text.slug(F.col("company")), F.lit(".example")),
        "available": F.element_at(F.create_map(*(F.lit(x) for kv in AVAILABLE.items() for x in kv)), F.col("stack")),
        "segment_conf": F.when(F.col("weak"), F.round(0.35 + (i % 15) / 100, 2)).otherwise(F.round(0.62 + (i % 30) / 100, 2)),
        "tag": F.concat(F.substring("source_mode", 1, 3), F.lit("-"), F.lpad(i.cast("string"), 3, "0"), F.lit("-"), F.lower(F.split_part("company", F.lit(" "), F.lit(1)))),
        "task_id": F.concat(F.upper(F.substring("source_mode", 1, 3)), F.lit("-"), F.lpad(i.cast("string"), 5, "0")),
        "stage": F.lit(STAGE),
        "kind": F.when(adversarial, "overcommit").when((F.col("source_mode") == "programmatic") & F.col("weak") & (i % 3 == 0), "assertive").when(F.col("weak"), "weak").otherwise("strong"),
    })
    values = {k: F.col(k) for k in ("company", "stage", "closed_at", "roles_60", "roles_today", "stack", "tag")}
    subject = body = None
    for k in SUBJECTS:
        s, b = _fill(SUBJECTS[k], values), _fill(BODIES[k], values)
        subject = F.when(F.col("kind") == k, s) if subject is None else subject.when(F.col("kind") == k, s)
        body = F.when(F.col("kind") == k, b) if body is None else body.when(F.col("kind") == k, b)
    return df.withColumns({
        "velocity": F.when(F.col("weak"), "insufficient_signal").when(F.col("roles_today") >= 6, "doubled").otherwise("increased_modestly"),
        "bench_state": F.when(F.col("available") < F.col("headcount") * 2, "tight").otherwise("healthy"),
        "pricing_request": F.when(F.col("headcount") >= 8, "custom_multiphase").otherwise("public_band"),
        "generator": F.when(adversarial, "human_author").when(F.col("source_mode") == "trace_derived", "trace_source").when(F.col("source_mode") == "programmatic", "template_engine").when(i % 4 == 0, "Frontier/large-1").otherwise("Cheap/small-1"),
        "subject": subject,
        "body": body,
    })


def tasks(spark: SparkSession, n: int = 240) -> DataFrame:
    """The same tasks in nested form, as they are read from and written to JSON lines."""
    f = flat_tasks(spark, n)
    caps = F.create_map(*(F.lit(x) for kv in AVAILABLE.items() for x in kv))
    from quern.functions.safe import map_slice

    sliced = map_slice(caps, F.array(F.col("stack"), F.lit("python"), F.lit("data")))
    return f.select(
        "task_id", "source_mode", "difficulty",
        F.struct(F.col("tag").alias("lexical_tag"), F.col("generator").alias("generator_model"), F.lower(F.split_part("generator", F.lit("/"), F.lit(1))).alias("generator_model_family"), F.struct("company_size", "segment", F.col("headcount").alias("headcount_request"), "stack", "bench_state").alias("slot_values"), F.lit(f"{CLOCK}T00:00:00+00:00").alias("created_at")).alias("metadata"),
        F.struct(
            "outreach_type",
            F.struct(F.col("company").alias("prospect_name"), F.col("domain").alias("prospect_domain"), "generated_at", F.col("segment").alias("primary_segment_match"), F.col("segment_conf").alias("segment_confidence"), F.struct(F.col("roles_today").alias("open_roles_today"), F.col("roles_60").alias("open_roles_60_days_ago"), F.col("velocity").alias("velocity_label")).alias("hiring_velocity"),
                F.struct(F.struct("stage", "closed_at").alias("funding_event"), F.struct(F.col("layoff_date").alias("date")).alias("layoff_event"), F.struct("started_at").alias("leadership_change")).alias("buying_window_signals"), F.when(F.col("weak"), F.array(F.lit("weak_hiring_velocity_signal"))).otherwise(F.array().cast("array<string>")).alias("honesty_flags")).alias("hiring_signal_brief"),
            F.struct(F.transform_values(sliced, lambda _, v: F.struct(v.alias("available_engineers"))).alias("stacks")).alias("bench_summary"),
            F.struct(F.array(F.struct("stack", F.col("headcount").alias("count"))).alias("requested_capacity"), "pricing_request", F.struct("company_size", "segment").alias("company_profile"), "bench_state").alias("request_context"),
        ).alias("input"),
        F.struct("subject", "body").alias("candidate_output"),
        F.struct(F.array(F.regexp_replace("stage", "_", " "), F.col("roles_today").cast("string")).alias("required_signal_phrases"), F.col("weak").alias("weak_signal_assertion_forbidden")).alias("rubric"),
    )


def _case(column: str, values: dict[str, str]) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in values.items()) + " end"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _concat(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for k in ("company", "stage", "closed_at", "roles_60", "roles_today", "stack", "tag"):
        out = out.replace("{" + k + "}", f"' || {k} || '")
    return out


def sql(n: int = 240) -> str:
    """A query for DuckDB with the rows of ``flat_tasks``."""
    at, modes = 0, []
    for m, k in scaled_quotas(QUOTAS, n).items():
        at += k
        modes.append(f"when idx <= {at} then '{m}'")
    pick = lambda values, i="idx": f"{_list(values)}[({i} % {len(values)} + 1)::int]"
    hash_ = "('0x' || substr(md5(idx::varchar), 1, 6))::bigint"
    return f"""
select *, case when weak then 'insufficient_signal' when roles_today >= 6 then 'doubled' else 'increased_modestly' end as velocity,
    case when available < headcount * 2 then 'tight' else 'healthy' end as bench_state, case when headcount >= 8 then 'custom_multiphase' else 'public_band' end as pricing_request,
    case when source_mode = 'hand_authored_adversarial' then 'human_author' when source_mode = 'trace_derived' then 'trace_source' when source_mode = 'programmatic' then 'template_engine'
        when idx % 4 = 0 then 'Frontier/large-1' else 'Cheap/small-1' end as generator,
    {_case("kind", {k: _concat(v) for k, v in SUBJECTS.items()})} as subject, {_case("kind", {k: _concat(v) for k, v in BODIES.items()})} as body
from (select *, greatest(0, roles_today - idx % 4)::int as roles_60, trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-') || '.example' as domain,
    {_case("stack", {k: str(v) for k, v in AVAILABLE.items()})}::int as available,
    case when weak then round(0.35 + (idx % 15) / 100.0::double, 2) else round(0.62 + (idx % 30) / 100.0::double, 2) end as segment_conf,
    substr(source_mode, 1, 3) || '-' || lpad(idx::varchar, 3, '0') || '-' || lower(split_part(company, ' ', 1)) as tag, upper(substr(source_mode, 1, 3)) || '-' || lpad(idx::varchar, 5, '0') as task_id,
    '{STAGE}' as stage, case when source_mode = 'hand_authored_adversarial' then 'overcommit' when source_mode = 'programmatic' and weak and idx % 3 = 0 then 'assertive' when weak then 'weak' else 'strong' end as kind
from (select *, idx % 5 = 0 or source_mode = 'hand_authored_adversarial' as weak, {pick(COMPANIES)} as company, {pick(SEGMENTS)} as segment, {pick(STACKS)} as stack, {pick(SIZES)} as company_size,
    (case when source_mode = 'hand_authored_adversarial' and idx % 2 = 0 then 10 else 2 + idx % 4 end)::int as headcount, (2 + idx % 10)::int as roles_today,
    {_case("source_mode", {m: pick(v, hash_) for m, v in DIFFICULTY.items()})} as difficulty,
    case when idx % 7 = 0 then 'warm' when idx % 11 = 0 then 'reengagement' else 'cold' end as outreach_type,
    strftime(date '{CLOCK}' - (20 + idx)::int, '%Y-%m-%d') as closed_at, strftime(date '{CLOCK}' - (50 + idx)::int, '%Y-%m-%d') as layoff_date, strftime(date '{CLOCK}' - (30 + idx)::int, '%Y-%m-%d') as started_at,
    strftime(timestamp '{CLOCK}' - to_hours((idx % 96)::int), '%Y-%m-%dT%H:%M:%S') || '+00:00' as generated_at
from (select idx, case {" ".join(modes)} end as source_mode from (select unnest(range(1, {n + 1}))::bigint as idx)))) t"""
