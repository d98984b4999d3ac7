import math
from collections import Counter, defaultdict

import pytest

from quern.llm import language
from tests.llm.conftest import EDGES, LONG

EN = ["the cat sat on the mat and the dog ran", "the dog and the cat are here with the mat", "that is the one and the only thing"]
DE = ["der hund und die katze sind hier", "die katze und der hund laufen nicht", "das ist der eine und nicht die andere"]
ROWS = [(i, t, "en") for i, t in enumerate(EN)] + [(10 + i, t, "de") for i, t in enumerate(DE)]
FIT = {"sample_rows": 10, "max_gram": 4, "min_count": 2}


def brute(train, texts, p, margin):
    """The same definition with plain dictionaries."""
    counts = defaultdict(Counter)
    for _, t, lang in train:
        for w in language.letter_words(t):
            counts[0][w, lang] += 1
            for k in range(1, p["max_gram"] + 1):
                for g in language.grams_of(w, k):
                    counts[k][g, lang] += 1
    langs = sorted({x[2] for x in train})
    known, score = defaultdict(set), {}
    for k, c in counts.items():
        total = Counter()
        for (g, _), n in c.items():
            total[g] += n
        known[k] = {g for g, n in total.items() if n >= p["min_count"]}
        for lang in langs:
            t = sum(n for (g, x), n in c.items() if x == lang and g in known[k])
            for g in known[k]:
                score[k, g, lang] = math.floor(1000 * math.log((c[g, lang] + 0.5) / (t + 0.5 * len(known[k]))))
    out = []
    for text in texts:
        sums, n = dict.fromkeys(langs, 0), 0
        for w in language.letter_words(text or ""):
            k, grams = 0, [w] if w in known[0] else []
            if not grams:
                for k in range(p["max_gram"], 0, -1):
                    grams = [g for g in language.grams_of(w, k) if g in known[k]]
                    if grams:
                        break
            if grams:
                n += 1
                for lang in langs:
                    sums[lang] += sum(score[k, g, lang] for g in grams) // len(grams)
        ranked = sorted(langs, key=lambda x: (-sums[x], x))
        m = (sums[ranked[0]] - sums[ranked[1]]) // n if n else 0
        out.append((ranked[0] if n and m >= margin else "und", m, n))
    return out


def test_against_brute_force(spark, table):
    texts = [t for _, t, _ in ROWS] + ["the katze", "hundkatze", "zzz", "cat", "", None]
    train = spark.read.parquet(table(ROWS))
    model = language.fit(train, **FIT)
    docs = spark.read.parquet(table([(i, t) for i, t in enumerate(texts)]))
    got = {r["doc_id"]: (r["pred_lang"], r["margin"], r["n_scored"]) for r in language.identify(docs, model, 40).collect()}
    assert [got[i] for i in range(len(texts))] == brute(ROWS, texts, FIT, 40)


def test_edges(spark, table):
    model = language.fit(spark.read.parquet(table(ROWS)), **FIT)
    docs = spark.read.parquet(table(EDGES))
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(EDGES)
    assert all(not r["accepted"] for r in rows if r["doc_id"] in (1, 2, 5))
    assert next(r for r in rows if r["doc_id"] == 4)["n_scored"] == len(LONG.split())
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in rows)


def test_empty(spark, table):
    empty = spark.read.parquet(table([]))
    model = language.fit(empty, **FIT)
    assert model.langs == [] and language.identify(empty, model).count() == 0
    assert not any(r["accepted"] for r in language.identify(spark.read.parquet(table(ROWS)), model).collect())


def test_one_language_and_unlabelled(spark, table):
    model = language.fit(spark.read.parquet(table([*ROWS[:3], (99, "x y", None)])), **FIT)
    assert model.langs == ["en"]
    assert language.identify(spark.read.parquet(table([(1, "the cat")])), model).first()["pred_lang"] == "en"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"), **language.PARAMS)
    test = docs.where("doc_id % 2 = 1")
    got = language.identify(test, model).join(test.select("doc_id", "lang"), "doc_id")
    assert got.where("pred_lang = lang").count() >= 0.97 * test.count()


def test_bad_params(spark, table):
    with pytest.raises(Exception):  # noqa: B017
        language.fit(spark.read.parquet(table(ROWS)).drop("lang"))
