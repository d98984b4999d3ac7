import pytest
from pyspark.sql import functions as F

from quern.operators import merging, overlap, selection, stats
from quern.sources import model, records


def test_pairs_and_generated_rows(spark):
    df = spark.createDataFrame([(1, True, "a"), (1, False, "b"), (2, False, "c"), (3, True, None), (3, False, "d")], "p int, lead boolean, f string")
    got = sorted(map(tuple, merging.copy_within_pair(df, "p", F.col("lead"), "f").select("p", "lead", "f").collect()), key=str)
    assert got == sorted([(1, True, "a"), (1, False, "a"), (2, False, "c"), (3, True, None), (3, False, "d")], key=str)
    tasks = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "i bigint, body string")
    one = spark.createDataFrame([("1", " "), ("2", "m2"), ("2", "m1"), ("x", "m")], "i string, body string")
    two = spark.createDataFrame([("1", "n1"), (None, "n")], "i string, body string")
    assert sorted(map(tuple, merging.over_templates(tasks, "i", [one, two], ["body"]).collect())) == [(1, "n1"), (2, "m1"), (3, "t3")]


def test_export(spark):
    def client(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p + "Subject: Short note\nBody: Hiring grows. Would you reply?" for p in prompts]

    rows = [("a", "one ", "cold", ["hiring"], "s_t", 3, "none"), ("b", "bad ", "warm", ["hiring"], "s_t", 3, "none")]
    t = spark.createDataFrame(rows, "task_id string, prompt string, outreach_type string, required array<string>, stage string, roles int, fallback string").coalesce(1)
    got = {r["task_id"]: r for r in merging.export(t, client, batch=1, wait=0).collect()}
    assert got["a"]["subject"] == "Request: Short note" and got["a"]["body"] == "Hiring grows. Would you reply?" and got["a"]["generated"]
    assert not got["b"]["generated"] and "3 open roles" in got["b"]["body"]


def test_gates_and_heads(spark):
    df = spark.createDataFrame([(2, "A/x"), (1, "b/y"), (3, None)], "pos int, m string")
    assert [r["pos"] for r in selection.head(df, "pos", 2).orderBy("pos").collect()] == [1, 2]
    with pytest.raises(ValueError):
        selection.require_other_family(["a/x", "B/y"], "b/judge")
    selection.require_other_family(["a/x"], "b/judge")
    with pytest.raises(ValueError):
        selection.require_filled(df, "m")
    selection.require_filled(df, "pos")


def test_summaries(spark):
    r = spark.createDataFrame([("train", 0, 0, 0.1, 0, True), ("dev", 0, 0, 0.2, 0, True)], "ref_split string, max_shared bigint, ngram_pairs bigint, max_cosine double, cosine_pairs bigint, pass boolean")
    none = spark.createDataFrame([], "id int, issue string")
    assert tuple(overlap.summary(r, none).first()) == (0, 0, 0.2, 0, 0, True)
    assert tuple(overlap.summary(r, spark.createDataFrame([(1, "x")], "id int, issue string")).first()) == (0, 0, 0.2, 0, 1, False)
    v = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0)], "v string, x double")
    assert stats.mean_differences(v, "v", "a", "b", ["x"]).first()[0] == 1.0
    assert stats.mean_differences(v, "v", "a", "none", ["x"]).first()[0] is None


def test_embedder_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    _, name = model.embed_or_hash(df, "id", "text")
    assert name == "hash"
    got, name = model.embed_or_hash(df, "id", "text", lambda texts: [[1.0, float(len(t))] for t in texts])
    assert name == "model" and got.first()["embedding"] == [1.0, 3.0]
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n')
    (tmp_path / "b.jsonl").write_text('{"n": 2}\n{"n": 3}\n')
    named = records.read_named(spark, {"x": str(tmp_path / "a.jsonl"), "y": str(tmp_path / "b.jsonl")}, "n int")
    assert sorted(map(tuple, named.select("n", "split").collect())) == [(1, "x"), (2, "y"), (3, "y")]
    assert records.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2}], "a int, b string", ["b"]).columns == ["b"]
