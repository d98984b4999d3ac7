import math
from collections import defaultdict
from hashlib import md5

import numpy as np

from quern.llm import mixing
from tests.llm.conftest import EDGES


def brute(rows, p):
    """The same definition in plain loops: probability of each cell, and the rows drawn."""
    def cell(r):
        t = r[1] or ""
        topic = next((n for n, marks in mixing.TOPICS if any(m in t for m in marks)), mixing.TOPIC_REST)
        return (r[3] or mixing.NONE, r[2] or mixing.NONE, topic)

    tokens = defaultdict(int)
    for r in rows:
        tokens[cell(r)] += len((r[1] or "").split())
    tokens = {c: n for c, n in tokens.items() if n}
    total = sum(tokens.values())
    w = {c: float(n) for c, n in tokens.items()}
    goals = []
    for i, m in enumerate(mixing.MARGINS):
        share = defaultdict(float)
        for c, n in tokens.items():
            share[c[i]] += n / total
        g = {k: v ** p[f"{m}_power"] for k, v in share.items()}
        goals.append({k: v / sum(g.values()) for k, v in g.items()})
    for _ in range(500):
        for i, goal in enumerate(goals):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[i]] += x
            w = {c: x * goal[c[i]] / have[c[i]] for c, x in w.items()}
    f = {c: w[c] * total / tokens[c] for c in w}
    def shares(keep):
        low, high = 0.0, 1e9
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(1, mid * f[c]) * tokens[c] for c in f) < keep * total else (low, mid)
        prob = {c: min(1.0, low * f[c]) for c in f}
        drawn = sum(prob[c] * tokens[c] for c in f)
        off = max((abs(sum(prob[c] * tokens[c] for c in f if c[i] == k) / drawn - v) for i, goal in enumerate(goals) for k, v in goal.items()), default=0)
        return off, prob

    prob = {}
    for k in range(round(100 * p["keep"]), 0, -1):
        off, prob = shares(k / 100) if f else (0, {})
        if off <= p["tolerance"]:
            break
    else:
        _, prob = shares(min(0.01, 1 / max(f.values())))
    u = lambda r: int(md5((p["seed"] + (str(r[0]) if r[0] is not None else r[1] or "")).encode()).hexdigest()[:13], 16) / 16**13
    return prob, [r for r in rows if cell(r) in prob and u(r) < prob[cell(r)]], (w, goals)


def corpus():
    langs, sources = ["en", "en", "en", "de", None], ["hot"] * 6 + ["b", "c", None]
    return [(i, " ".join(["w"] * (1 + i * 7 % 40)) + (" license" if i % 9 == 0 else " ###" if i % 11 == 0 else ""), langs[i % 5], sources[i % 9]) for i in range(400)]


def test_against_brute_force(spark, table):
    rows, p = corpus(), mixing.PARAMS | {"keep": 0.6}
    prob, drawn, _ = brute(rows, p)
    got = mixing.mix_plan(spark.read.parquet(table(rows)), keep=0.6).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in drawn)
    assert all(math.isclose(r["prob"], prob[r["source"], r["lang"], r["topic"]], abs_tol=2e-6) for r in got)
    assert {r["doc_id"] for r in mixing.mix(spark.read.parquet(table(rows)), keep=0.6).collect()} == {r[0] for r in drawn}


def test_raking_meets_margins():
    rows = corpus()
    _, _, (w, goals) = brute(rows, mixing.PARAMS)
    cells = sorted(w)
    codes = [np.unique([c[i] for c in cells], return_inverse=True)[1] for i in range(3)]
    tokens = np.ones(len(cells))
    targets = [np.array([g[k] for k in sorted(g)]) for g in goals]
    raked = mixing.rake(tokens, codes, targets)
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, weights=raked), target, atol=1e-11)


def test_calibration():
    tokens, factor = np.array([10, 20, 30]), np.array([5.0, 1.0, 0.2])
    p = mixing.calibrate(tokens, factor, 40)
    assert math.isclose(float((p * tokens).sum()), 40) and p.max() <= 1
    assert (mixing.calibrate(tokens, factor, 60) == 1).all()


def test_edges(spark, table):
    docs = spark.read.parquet(table(EDGES))
    got = mixing.mix(docs, keep=1.0)
    assert got.columns == docs.columns
    assert got.where("text is not null and text <> ''").count() == sum(bool(t) for _, t, *_ in EDGES)
    assert mixing.mix(spark.read.parquet(table([]))).count() == 0 and mixing.mix_plan(spark.read.parquet(table([]))).count() == 0


def test_raking_ends_where_margins_contradict():
    w = mixing.rake(np.array([1, 1]), [np.array([0, 1]), np.array([0, 1]), np.array([0, 0])], [np.array([0.5, 0.5]), np.array([0.3, 0.7]), np.array([1.0])])
    assert np.isfinite(w).all() and (w > 0).all()


def test_tolerance_reaches_targets_on_a_hot_source(spark, table):
    """Shares of the tokens really drawn, against the targets, where one source holds most tokens."""
    rows = [(i, " ".join(["w"] * (20 if i % 10 else 7)) + (" ###" if i % 11 == 0 else ""), ["en", "de", "en"][i % 3], "hot" if i % 10 else f"s{i // 10 % 4}") for i in range(20_000)]
    docs = spark.read.parquet(table(rows))
    _, _, (_, goals) = brute(rows, mixing.PARAMS)

    def off(**params):
        got = mixing.mix_plan(docs, **params).toPandas()
        return max(abs(got.loc[got[m] == k, "n_tokens"].sum() / got["n_tokens"].sum() - v) for m, goal in zip(mixing.MARGINS, goals, strict=True) for k, v in goal.items())

    assert off(tolerance=1.0) > 0.05
    assert off() < 0.025


def test_drawn_shares_meet_targets(spark):
    """On the largest table of the tests, with the query's own parameters."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix_plan(docs, **mixing.PARAMS).toPandas()
    cells = mixing.cell_plan(docs).toPandas()
    for m in mixing.MARGINS:
        drawn = got.groupby(m)["n_tokens"].sum() / got["n_tokens"].sum()
        want, expected = cells.groupby(m)["target"].sum(), cells.groupby(m)["expected"].sum()
        assert (expected - want).abs().max() <= 0.01
        assert (drawn - want).abs().max() <= 0.015
