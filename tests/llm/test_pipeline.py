"""The pipeline's stages in order, and its result against a brute-force version of them."""

from quern.llm import common, contamination, jaccard, language, mixing, sharding
from tests.llm import test_contamination, test_jaccard, test_mixing


def test_stages_are_named_and_keep_columns(spark, table):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]


def test_run_against_brute_force(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    # 1: what the model rejects goes (the model is tested on its own)
    model = language.fit(docs, **language.PARAMS)
    ok = {r["doc_id"] for r in language.identify(docs, model).collect() if r["accepted"]}
    rows = [r for r in rows if r[0] in ok]
    # 6: one of each connected component
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in test_jaccard.brute_pairs(rows, jaccard.PARAMS["n"], jaccard.PARAMS["permille"]):
        x, y = sorted((find(a), find(b)), key=lambda i: rows[i][0])
        root[y] = x
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    # 8: none with a run of eight tokens of the benchmark
    n = contamination.PARAMS["min_tokens"]
    words = lambda t: common.WORD.findall((t or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    leaked = set().union(*(grams(words(r["text"])) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()))
    rows = [r for r in rows if not grams(words(r[1])) & leaked]
    # 3: drawn rows
    _, rows, _ = test_mixing.brute(rows, mixing.PARAMS)
    got = corpus_pipeline.run(spark, d)
    assert got.columns == [*docs.columns, "old_shard", "new_shard"]
    placed = got.collect()
    assert sorted(r["doc_id"] for r in placed) == sorted(r[0] for r in rows)
    assert {r["doc_id"]: r["text"] for r in placed} == {r[0]: r[1] for r in rows}
    # 10: shards by source in order, each new one within its room
    names = sorted({r["source"] for r in placed})
    assert all(names[r["old_shard"]] == r["source"] for r in placed)
    assert all(0 <= r["new_shard"] < sharding.PARAMS["n_shards"] for r in placed)
    assert test_contamination.brute([(r["doc_id"], r["text"]) for r in placed][:20], [(0, "zz zz zz zz zz zz zz zz")], n) == []


def test_registry_names_all():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
