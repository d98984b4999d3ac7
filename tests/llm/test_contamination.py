import random

from quern.llm import common, contamination
from tests.llm.conftest import EDGES


def brute(docs, items, least):
    out = []
    for d, t in docs:
        w = common.WORD.findall((t or "").lower())
        for i, x in items:
            v = common.WORD.findall((x or "").lower())
            best = None
            for p in range(len(w)):
                for q in range(len(v)):
                    k = 0
                    while p + k < len(w) and q + k < len(v) and w[p + k] == v[q + k]:
                        k += 1
                    if k >= least and (best is None or (-k, p, q) < best):
                        best = (-k, p, q)
            if best:
                out.append((d, i, -best[0], best[1], best[2]))
    return sorted(out, key=str)


def run(spark, path, bench, least=3, **kw):
    rows = contamination.matches(spark.read.parquet(path), bench, least, **kw).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_against_brute_force(spark, table):
    r = random.Random(3)
    word = lambda: r.choice("abcdefg")
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 2, 5, 40, 120])))) for i in range(30)]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 8, 20])))) for i in range(12)]
    docs += [(100, docs[3][1] + " zz " + items[2][1]), (101, items[5][1].upper() + "!"), (102, None), (101, items[5][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items, 4)
    assert len(want) > 20
    path = table(docs)
    for kw in ({}, {"shard_tokens": 50}, {"test_tokens": 30}):
        assert run(spark, path, bench, 4, **kw) == want
    dirty = {d for d, *_ in want}
    kept = contamination.keep_clean(spark.read.parquet(path), bench, 4, test_tokens=30)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)


def test_edges(spark, table):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (None, "gamma delta alpha beta gamma delta alpha beta gamma"), (2, None), (3, ""), (4, "a b")], "item_id bigint, text string")
    docs = spark.read.parquet(table(EDGES))
    got = run(spark, table(EDGES), bench, 8)
    assert [g for g in got if g[1] == 1] == [(3, 1, 8, 0, 0), (3, 1, 8, 0, 0), (None, 1, 8, 0, 0)]
    assert [g for g in got if g[1] is None] == [(4, None, 9, 2, 0)]
    kept = contamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(EDGES) - 4


def test_empty(spark, table):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.read.parquet(table(EDGES))
    assert contamination.matches(docs, none).count() == 0 and contamination.keep_clean(docs, none).count() == len(EDGES)
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string")
    assert contamination.matches(spark.read.parquet(table([])), some).count() == 0


def test_long_item(spark, table):
    """An item of 20,000 tokens, matched over 15,000 of them; memory follows its length and not its square."""
    words = [f"t{i}" for i in range(20_000)]
    test = contamination.Test([(1, words), (2, words[:9])], 8)
    assert test.tokens.nbytes < 100_000 and len(test.place) == 19_993 + 2
    docs = [(5, "zz " + " ".join(words[2000:17_000]) + " zz"), (6, " ".join(words[:7])), (7, "")]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    assert run(spark, table(docs), bench, 8) == [(5, 1, 15_000, 1, 2000)]
