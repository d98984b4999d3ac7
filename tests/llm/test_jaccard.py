import random

import numpy as np
import pytest

from quern.llm import common, jaccard
from tests.llm.conftest import EDGES


def sets_of(rows, n):
    out = {}
    for i, (_, t, *_) in enumerate(rows):
        w = common.WORD.findall((t or "").lower())
        if w:
            k = min(n, len(w))
            out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    return out


def brute_pairs(rows, n, permille):
    """Pairs of row numbers at or over the threshold."""
    s = sets_of(rows, n)
    keys = sorted(s)
    return {(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if len(s[a] & s[b]) * 1000 >= permille * len(s[a] | s[b])}


def brute_classes(rows, n, permille):
    """(doc_id, class_id, n_links, best_jaccard) of each row, by comparing every two."""
    s, root, links, best = sets_of(rows, n), list(range(len(rows))), [0] * len(rows), [0.0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows, n, permille):
        j = len(s[a] & s[b]) / len(s[a] | s[b])
        for x in (a, b):
            links[x] += 1
            best[x] = max(best[x], j)
        root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], least.get(find(i)), links[i], round(best[i], 6)) for i, r in enumerate(rows)), key=str)


def classes(docs, *args, **kw):
    return sorted((tuple(r) for r in jaccard.join(docs, *args, **kw).collect()), key=str)


def corpus(seed, size=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    hot = " ".join(vocab[:12])
    rows, base = [], []
    for i in range(size):
        kind = r.random()
        if kind < 0.4 or not base:
            w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 6, 20, 60]))]
            base.append(w)
        elif kind < 0.55:
            w = list(r.choice(base))
        else:
            w = list(r.choice(base))
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w) + (" " + hot if r.random() < 0.2 else "")))
    return rows


PARAMETERS = [(1, 600, None, (32, 128), 3), (2, 600, (3, 9), (32, 128), 3), (3, 300, (2, 4), (40, 50), 2), (4, 800, (2, 30), (60, 60), 1), (5, 500, (8, 20), (10, 30), 2), (6, 600, (1, 2), (64, 64), 2)]


@pytest.mark.parametrize(("seed", "permille", "limits", "tiers", "n"), PARAMETERS)
def test_join_against_brute_force(spark, table, seed, permille, limits, tiers, n):
    rows = corpus(seed)
    assert classes(spark.read.parquet(table(rows)), n, permille, limits, tiers) == brute_classes(rows, n, permille)


def test_many_near_copies_use_blocks_and_pieces(spark, table):
    base = [f"t{i}" for i in range(50)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i in range(60) for k in [i % 50]]
    want = brute_classes(rows, 3, 600)
    assert sum(x[2] for x in want) > 1000
    docs = spark.read.parquet(table(rows))
    assert classes(docs, 3, 600) == want
    assert classes(docs, 3, 600, chunk=7) == want


def test_keep_one_against_brute_force(spark, table):
    rows = corpus(7)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows, 3, 600):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    kept = jaccard.keep_one(spark.read.parquet(table(rows)), 3, 600)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def test_edges(spark, table):
    docs = spark.read.parquet(table(EDGES))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    # of the three rows of one text the smallest doc_id stays, once; rows without words all stay
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("a b c d e f g h") == 1 and len(texts) == len(EDGES) - 2
    assert [r["doc_id"] for r in kept.where("text = 'a b c d e f g h'").collect()] == [3]
    assert classes(docs) == brute_classes(EDGES, 3, 600)


def test_empty_and_in_memory(spark, table):
    assert jaccard.join(spark.read.parquet(table([]))).count() == 0
    assert jaccard.keep_one(spark.read.parquet(table([]))).count() == 0
    memory = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in jaccard.keep_one(memory).collect()] == [1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["row"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_packed_order_survives_truncated_ties():
    keys = np.array([8, 9, 8, 9, 1 << 60, 9], dtype=np.uint64)
    order = jaccard._order(keys)
    assert (np.diff(keys[order].astype(object)) >= 0).all()


@pytest.mark.parametrize("tiers", [(0, 0), (0, 12), (12, 16), (40, 40)])
def test_signature_guarantee(tiers):
    """Any two sets at the threshold share a signature, whatever the classes; triples and pairs are really used."""
    r = np.random.default_rng(0)
    found = 0
    for _ in range(3000):
        universe = np.sort(r.integers(1, 2**62, 40, dtype=np.uint64))
        codes = np.sort(r.integers(8, 60, 40)).astype(np.uint8)
        a = np.sort(r.choice(40, r.integers(1, 20), replace=False))
        b = np.sort(np.union1d(a[r.random(len(a)) > 0.15], r.choice(40, 2)))
        if len(np.intersect1d(a, b)) * 1000 < 600 * len(np.union1d(a, b)):
            continue
        found += 1
        sa, sb = (jaccard.signatures(len(x), universe[x], codes[x], 600, (8, 24), tiers) for x in (a, b))
        assert len(np.intersect1d(sa, sb))
    assert found > 300
    assert sorted(jaccard.schemes(20, 600, (20, 40))) == [2, 3] and list(jaccard.schemes(200, 600, (20, 40))) == [1]
