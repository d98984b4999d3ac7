import re

from pyspark.sql import functions as F

from quern.functions import safe, text
from quern.operators import posts


WORD, END = r"\b[-\w']+\b", r"(?<=[!.?])\s+"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_text(spark):
    for s in ["a-b it's — Ünï  x", "", " \t\n", "''", "x_y 1.5", "l'été où"]:
        assert one(spark, s, text.word_count) == sum(1 for _ in re.finditer(WORD, s))
        assert one(spark, s, text.normalize) == " ".join(s.lower().split())
        assert one(spark, s, text.words) == s.split()
        assert one(spark, s, text.token_estimate) == max(1, int(len(s.split()) * 1.3))
        assert one(spark, s, text.sentences) == list(filter(None, map(str.strip, re.split(END, s.strip()))))
    assert one(spark, "One. Two!  Three?\nFour", text.sentences) == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, ["a", "b"], lambda c: text.ngram_set(c, 3), "array<string>") == []
    assert one(spark, ["a", "b", "a", "b"], lambda c: text.ngram_set(c, 2), "array<string>") == ["a b", "b a"]
    assert one(spark, "Larch & Loom!", text.slug) == "larch-loom"
    assert tuple(one(spark, "Subject: S x\nBody: B\ny ", text.parse_rendered)) == ("S x", "B\ny")
    assert tuple(one(spark, "Body: B", text.parse_rendered)) == ("", "Body: B")
    assert tuple(one(spark, "noise\nSUBJECT:  S\nbody:  text", text.parse_labelled)) == ("S", "text")
    assert tuple(one(spark, '{"subject": "s", "body": 3}', text.parse_output)) == ("s", "3")
    assert tuple(one(spark, "[1]", text.parse_output)) == ("", "") and tuple(one(spark, "plain", text.parse_output)) == ("", "plain")


def test_candidates_and_prompts(spark):
    from quern.operators import prompts, synth

    for given, want in [('{"subject": "s", "body": "b"}', ("s", "b")), ('{"candidate_output": {"body": "b"}}', ("", "b")), ("Subject: s\nBody: b", ("s", "b")), ("text", ("", "text")), ("[1]", ("", "")), ('{"a": 1}', ("", "")), ('{"a": 1} tail', ("", '{"a": 1} tail')), (None, ("", ""))]:
        assert tuple(one(spark, given, text.parse_candidate)) == want
    assert one(spark, "hi", lambda c: prompts.chatml(("user", c))) == "<|im_start|>user\nhi<|im_end|>\n"
    t = synth.tasks(spark, 3)
    p = t.select(prompts.task_prompt(F.col("input"), tuple(t.schema["input"].dataType.names))).first()[0].split("\n")
    assert p[0] == prompts.ASK and len(p) == 5 and p[2].startswith('hiring_signal_brief: {"prospect_name"')
    assert one(spark, None, lambda c: prompts.prompt_only(c, c, c, c)["body"]).startswith("Hello there, open roles went from N/A")
    assert "Phrases:  a, b" in one(spark, "x", lambda c: prompts.revision_prompt(c, c, c, F.lit(5), F.array(F.lit(" a"), F.lit(""), F.lit("b"))))


def test_safe(spark):
    assert [one(spark, v, safe.safe_int) for v in ("3", "3.7", "x", None)] == [3, 0, 0, 0]
    assert one(spark, 3.9, safe.safe_int, "double") == 3
    assert one(spark, None, safe.safe_text) == "" and one(spark, "A/b/c", safe.family) == "a" and one(spark, "Ab", safe.family) == "ab"
    assert [one(spark, v, safe.clamp, "int") for v in (0, 3, 9)] == [1, 3, 5]
    assert one(spark, {"a": 1, "b": 2}, lambda c: safe.map_slice(c, F.array(F.lit("b"))), "map<string,int>") == {"b": 2}


def test_posts(spark):
    assert one(spark, "Subject: x\nBody: Hello\n this response is tailored\nmore\nBest regards\nMe", posts.clean_body) == "Hello more"
    assert one(spark, "Subject: only", posts.clean_body) == "Subject: only" and one(spark, "a\n---\nb", posts.clean_body) == "a"
    assert one(spark, "Can we talk? Fine. Would you come? End.", posts.single_cta) == "Can we talk? Fine. End."
    assert one(spark, "Fine.", posts.single_cta) == f"Fine. {posts.DEFAULT_ASK}"
    assert one(spark, " ".join(["w"] * 119 + ["x,", "y"]), lambda c: posts.trim_words(c, F.lit("cold"))) == " ".join(["w"] * 119 + ["x."])
    assert one(spark, "[Plan]", posts.normalize_subject) == "Request: Plan" and one(spark, "", posts.normalize_subject) == f"Request: {posts.DEFAULT_SUBJECT}"
    assert one(spark, "subject: request: a", posts.normalize_subject) == "request: a" and one(spark, "x" * 60, posts.normalize_subject) == f"Request: {posts.DEFAULT_SUBJECT}"
    need = lambda c: posts.require_phrase(c, F.array(F.lit("series b"), F.lit(" ")), F.lit("series_b"), F.lit(4))
    assert one(spark, "Series B here", need) == "Series B here" and one(spark, "x", need) == "x I noticed a series b signal and 4 open roles."
