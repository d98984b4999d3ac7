import numpy as np

from quern.llm import quality
from tests.llm.conftest import EDGES

P = [quality.PARAMS[k] for k in ("min_df", "alpha", "c", "beta", "epochs")]


def test_descent_solves_the_dual():
    """Against projected gradient steps on the primal's subgradient: no worse an objective."""
    r = np.random.default_rng(0)
    x, w0 = r.normal(size=(60, 5)), r.normal(size=5)
    y = np.sign(x @ w0 + 0.3 * r.normal(size=60))
    rows = [(np.arange(5), v) for v in x]
    w = quality.dual_coordinate_descent(rows, y, 5, 1.0, 200)
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    best = np.zeros(5)
    v = np.zeros(5)
    for k in range(20_000):
        active = y * (x @ v) < 1
        v = v - (v - (y[active, None] * x[active]).sum(axis=0)) / (k + 10)
        best = v if loss(v) < loss(best) else best
    assert loss(w) <= loss(best) * 1.01


def test_scorer_against_plain_sums():
    texts = ["good words here good", "good words there", "bad stuff here bad", "bad stuff there ###"] * 3
    model = quality.train(texts, [1, 1, 0, 0] * 3, *P)
    model = {g: v if isinstance(v, tuple) else (v, 0.0) for g, v in model.items()}
    scorer = quality._Scorer(model)
    for t in [*texts, "good bad good words", "nothing", "", None]:
        have = [g for g in (quality.features(quality.tokens(t)) if t else ()) if g in model]
        norm = sum(model[g][1] ** 2 for g in have) ** 0.5 or 1.0
        assert abs(scorer.score(t) - (model[""][0] + sum(model[g][0] for g in have) / norm)) < 1e-9
    assert scorer.score(texts[0]) > 0 > scorer.score(texts[2])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    test = labels.where("doc_id % 2 = 1")
    got = quality.classify(docs.join(test.select("doc_id"), "doc_id", "left_semi"), model).join(test, "doc_id")
    right = got.where("cast(good as int) = quality").count() / got.count()
    assert right > 0.94  # always saying good: 0.86


def test_edges(spark, table):
    docs = spark.read.parquet(table(EDGES))
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, 1), (None, 1), (6, None), (77, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(EDGES)
    none = quality.fit(docs, labels.where("false"))
    assert all(r["score"] == 0 and r["good"] for r in quality.classify(docs, none).collect())
    one = quality.fit(docs, labels.where("quality = 0"))
    assert not any(r["good"] for r in quality.classify(docs, one).collect())
    assert quality.classify(spark.read.parquet(table([])), none).count() == 0
