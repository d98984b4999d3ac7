"""Rubric: golden rows, edge rows and properties."""

import re

import pytest
from pyspark.sql import functions as F

from quern.functions import lexicon
from quern.operators import preferences, rubric, synth

SCHEMA = """task_id string, candidate_output string, override string, broken boolean,
input struct<outreach_type:string, bench_summary:struct<stacks:map<string,struct<available_engineers:int>>>, request_context:struct<requested_capacity:array<struct<stack:string,count:int>>>>,
rubric struct<required_signal_phrases:array<string>, weak_signal_assertion_forbidden:boolean>"""


def task(i, output, required=("10",), weak=False, kind="cold", caps=None, asked=(), override=None, broken=None):
    caps = {"go": (3,)} if caps is None else caps
    return (i, output, override, broken, (kind, (caps,), (list(asked),)), (list(required) if required is not None else None, weak))


def out(subject, body):
    import json

    return json.dumps(dict(body=body, subject=subject))


def run(spark, *rows):
    df = spark.createDataFrame(list(rows), SCHEMA)
    return {r["task_id"]: r for r in rubric.evaluate(df, output="override", broken="broken").collect()}


def test_golden(spark):
    """A clean text; hype and a weak claim; a promise beyond capacity with a total price and a rebate."""
    r = run(
        spark,
        task("clean", out("Request: a short call", "You list 10 roles. Would you talk on Monday")),
        task("hype", out("Quick chat", "We are world-class and you are clearly growing fast, so synergy and top talent await"), required=("series b",), weak=True),
        task("promise", out("Re: team", "Absolutely, we can deliver 12 go engineers. The total engagement is $1,200,000 with 30% off"), required=("30",), asked=[("go", 9)]),
    )
    c = r["clean"]
    assert c["marker_scores"].asDict() == dict.fromkeys(rubric.MARKERS, 5) and c["pass"] and c["aggregate_score_pct"] == 100.0
    h = r["hype"]
    assert h["marker_issues"]["direct"] == ["subject_banned_prefix", "subject_missing_intent_prefix", "no_explicit_ask"]
    assert h["marker_issues"]["grounded"] == ["no_required_signal_phrase_matched", "weak_signal_assertion:clearly growing fast"]
    assert h["marker_issues"]["professional"] == ["banned_phrases:world-class,top talent,quick chat,synergy"]
    assert h["aggregate_score_pct"] == 76.0 and not h["pass"] and h["hard_policy_violations"] == []
    p = r["promise"]
    over, money = "exceeds_bench:go", ["specific_total_contract_value_quoted", "discount_or_promo_offered"]
    assert p["marker_issues"]["honest"] == [f"capacity_commitment_{over}:12>3", f"requested_capacity_{over}:9>3", *money]
    assert p["hard_policy_violations"] == [f"capacity_commitment_{over}:12>3", *money]
    assert p["marker_scores"]["honest"] == 1 and not p["pass"]


def test_edges(spark):
    good = "Would you look at 10 roles"
    r = run(
        spark,
        task("text", good),
        task("array", "[1, 2]"),
        task("null", None, required=None),
        task("empty_list", out("Re: x", "would you"), required=()),
        task("empty_phrase", out("Re: x", "would you"), required=("",)),
        task("s60", out("Re: " + "x" * 56, good)),
        task("s61", out("Re: " + "x" * 57, good)),
        task("w120", out("Re: x", " ".join(["w"] * 115) + " " + good[:-6] + "10")),
        task("kind", out("Re: x", " ".join(["w"] * 150) + " would you 10"), kind="other"),
        task("warm", out("Re: x", " ".join(["w"] * 150) + " would you 10"), kind="WARM"),
        task("asks", out("Re: x", "Would you? Can we book, schedule 10")),
        task("facebook", out("Re: x", "facebook 10")),
        task("equal", out("Re: x", "would you take 3 go engineers 10")),
        task("over", out("Re: x", "would you take 4 senior go engineers 10")),
        task("unknown", out("Re: x", "would you take 1 rust engineer and 1 data engineer 10")),
        task("million", out("Re: x", "would you pay a million 10")),
        task("word", out("Re: x", "would you bench 10")),
        task("inside", out("Re: x", "would you benchmark 10")),
        task("spaces", out("Re: x", "would\t\nyou   10 and Circling   Back")),
        task("accents", out("Re: x", "é " * 121 + "would you 10")),
        task("override", out("Re: x", "nothing"), override=out("Re: x", "would you 10")),
        task("broken", out("Re: x", good), broken=True),
    )
    issues = lambda k, m: r[k]["marker_issues"][m]
    assert issues("text", "direct") == ["subject_missing_intent_prefix"] and issues("text", "grounded") == []
    assert "no_explicit_ask" in issues("array", "direct") and issues("null", "grounded") == []
    assert issues("empty_list", "grounded") == issues("empty_phrase", "grounded") == []
    assert issues("s60", "direct") == [] and issues("s61", "direct") == ["subject_too_long"]
    assert issues("w120", "direct") == [] and issues("kind", "direct") == ["body_word_limit_exceeded:153>120"] and issues("warm", "direct") == []
    assert issues("asks", "direct") == ["too_many_asks:5"] and issues("facebook", "direct") == []
    assert issues("equal", "honest") == [] and issues("over", "honest") == ["capacity_commitment_exceeds_bench:go:4>3"]
    assert issues("unknown", "honest") == ["capacity_commitment_exceeds_bench:data:1>0"]
    assert issues("million", "honest") == [] and issues("word", "professional") == ["external_bench_term_used"] and issues("inside", "professional") == []
    assert issues("spaces", "professional") == ["banned_phrases:circling back"] and issues("spaces", "direct") == []
    assert issues("accents", "direct") == ["body_word_limit_exceeded:124>120"]
    assert r["override"]["pass"] and r["broken"]["aggregate_score_pct"] == 20.0 and issues("broken", "honest") == ["task_parse_error"]


def test_properties(spark):
    for r in rubric.score_flat(synth.flat_tasks(spark)).collect():
        points = list(r["marker_scores"])
        assert r["aggregate_score_pct"] == 4 * sum(points) and all(1 <= p <= 5 for p in points)
        assert r["pass"] == (min(points) >= 4 and not r["hard_policy_violations"])


def test_nested_equals_flat(spark):
    nested = {r["task_id"]: r for r in rubric.evaluate(synth.tasks(spark)).collect()}
    for r in rubric.score_flat(synth.flat_tasks(spark)).collect():
        assert nested[r["task_id"]]["marker_issues"] == r["marker_issues"]


def test_quotas():
    assert synth.scaled_quotas({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert sum(synth.scaled_quotas(synth.QUOTAS, 251).values()) == 251 and synth.scaled_quotas({"a": 0}, 5) == {"a": 0}


def test_preferences_are_strict(spark):
    rows = preferences.pairs(synth.flat_tasks(spark)).collect()
    assert len(rows) == 240 and all(r["chosen_score"] > r["rejected_score"] for r in rows)
    assert {r["family"] for r in rows} <= {"BEN", "TON", "SIG", "SCH", "MTL"}


def test_lexicon_order():
    assert lexicon.HYPE[0] == "world-class" and len(lexicon.HYPE) == 23 and len(set(lexicon.ASKS)) == 7
    assert all(re.compile(p) for p in lexicon.ASKS)


@pytest.mark.parametrize(("family", "codes", "prompt"), [("BEN", ["discount_or_promo_offered"], ""), ("TON", ["banned_phrases:x"], ""), ("SIG", ["weak_signal_assertion:x"], ""), ("SCH", [], "Book it"), ("MTL", ["no_explicit_ask"], "x")])
def test_failure_family(spark, family, codes, prompt):
    df = spark.createDataFrame([(codes, prompt)], "c array<string>, p string")
    assert df.select(preferences.failure_family(F.col("c"), F.col("p"))).first()[0] == family
