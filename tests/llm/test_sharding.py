import itertools
import math
import os
import random

import numpy as np
import pytest

from quern.llm import sharding
from tests.llm.conftest import EDGES


def test_flow_is_cheapest():
    """Against all ways to place a few unit blocks."""
    r = random.Random(1)
    for _ in range(30):
        old, new = 3, 3
        blocks = [r.randint(0, 2) for _ in range(old)]
        mean = [float(r.randint(1, 9)) for _ in range(old)]
        room = [r.randint(0, 3) for _ in range(new)]
        units = [i for i, k in enumerate(blocks) for _ in range(k)]
        costs = [sum(mean[i] for i, j in zip(units, to, strict=True) if i != j) for to in itertools.product(range(new), repeat=len(units)) if all(to.count(j) <= room[j] for j in range(new))]
        if not costs:
            with pytest.raises(ValueError):
                sharding.plan_transfers(blocks, mean, room)
            continue
        moves = sharding.plan_transfers(blocks, mean, room)
        assert sum(mean[i] * (b - a) for i, a, b, _ in moves) == min(costs)
        after = list(blocks)
        for i, a, b, j in moves:
            after[i] -= b - a
            after[j] += b - a
        assert all(x <= y for x, y in zip(after, room, strict=True))


def corpus():
    r = random.Random(5)
    return [(i, "x" * r.randint(1, 400), "en", "hot" if i % 2 else f"s{i % 7}") for i in range(600)]


def test_reshard_moves_fewest_bytes(spark, table):
    p = {"n_shards": 5, "block_bytes": 1000, "slack": 0.02}
    rows = sharding.reshard(spark.read.parquet(table(corpus())), **p).select("quern_row.doc_id", "quern_row.text", "quern_shard", "quern_block", "quern_to", "quern_rewritten").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    size, to = {}, {}
    for r in rows:
        b = r["quern_shard"], r["quern_block"]
        size[b] = size.get(b, 0) + len(r["text"])
        assert to.setdefault(b, r["quern_to"]) == r["quern_to"]
    room = math.ceil(1.02 * len(size) / 5)
    assert all(sum(t == j for t in to.values()) <= room for j in range(5))
    # every old shard must lose what it has over the room (all of it if it has no new shard); the least bytes are its smallest blocks
    least = 0
    for i in {b[0] for b in size}:
        mine = sorted(v for b, v in size.items() if b[0] == i)
        least += sum(mine[: max(0, len(mine) - room) if i < 5 else len(mine)])
    assert sum(v for b, v in size.items() if to[b] != b[0]) == least
    changed = {b[0] for b in size if to[b] != b[0]} | {to[b] for b in size if to[b] != b[0]}
    assert all(r["quern_rewritten"] == (r["quern_to"] in changed) for r in rows)


def test_shards_stay_within_their_bytes(spark, table):
    """A hot source and very long documents, through the query's parameters."""
    r = random.Random(9)
    rows = [(i, "x" * (r.randint(40_000, 60_000) if i % 97 == 0 else r.randint(1, 2000)), "en", "hot" if i % 5 < 2 else f"s{i % 31:02}") for i in range(6000)]
    got = sharding.place(spark.read.parquet(table(rows))).select("doc_id", "text", "source", "old_shard", "new_shard").collect()
    assert sorted(x["doc_id"] for x in got) == list(range(6000))
    n, slack = sharding.PARAMS["n_shards"], sharding.PARAMS["slack"]
    cap = (1 + slack) * sum(len(x["text"]) for x in got) / n
    before, after, moved = {}, {}, 0
    for x in got:
        before[x["old_shard"]] = before.get(x["old_shard"], 0) + len(x["text"])
        after[x["new_shard"]] = after.get(x["new_shard"], 0) + len(x["text"])
        moved += len(x["text"]) * (x["old_shard"] != x["new_shard"])
    assert max(after.values()) <= math.ceil(cap) and set(after) <= set(range(n))
    # no plan moves less than what old shards have over the capacity
    least = sum(b if i >= n else max(0, b - cap) for i, b in before.items())
    assert least <= moved <= least + len(before) * slack * cap


def test_block_larger_than_a_share():
    """One block over an even share: it sets the capacity, and all else fits."""
    shard, size = np.array([0, 0, 0, 1, 1]), np.array([1000, 10, 10, 10, 0])
    to, cap = sharding.pack_blocks(shard, size, 2, 4, 0.02)
    assert cap == 1000 and max(np.bincount(to, weights=size, minlength=4)) == 1000


def test_edges(spark, table):
    docs = spark.read.parquet(table(EDGES))
    got = sharding.place(docs, n_shards=3)
    assert got.columns == [*docs.columns, "old_shard", "new_shard"] and got.count() == len(EDGES)
    twice = sharding.place(got.drop("new_shard"), n_shards=3)
    assert twice.columns == got.columns
    assert sharding.place(spark.read.parquet(table([]))).count() == 0


def test_rewrite_leaves_unaffected_files(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    rows = [(i, "x" * 100, 0 if i < 400 else 1 + i % 3) for i in range(800)]
    spark.createDataFrame(rows, "doc_id bigint, text string, old_shard int").repartition(1).write.partitionBy("old_shard").parquet(src)
    affected = sharding.rewrite(spark, src, dst, n_shards=8, block_bytes=2000, slack=0.8)
    got = spark.read.parquet(dst)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(800))
    names = lambda d, k: {f for f in os.listdir(f"{d}/{k}") if f.endswith(".parquet")}
    same = [i for i in range(4) if i not in affected]
    assert 0 in affected and same
    assert all(names(src, f"old_shard={i}") == names(dst, f"shard={i}") for i in same)


def test_query_writes_affected_shards(spark, tmp_path):
    """The query's rewritten rows come, whole, from files of their new shard; the others stay where they are."""
    from quern.llm import common

    rows = [(i, "x" * (1 + i % 300), "en", "a" if i % 10 < 3 else f"s{i % 23:02}", i % 300) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    common.release(spark)
    got = sharding.query(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    assert any(r["moved"] for r in got) and not all(r["rewritten"] for r in got)
    (where,) = [p for p in common._written if "quern-resharded-" in p]
    files = {}
    for r in spark.read.parquet(where).select("quern_row.*", "quern_to").collect():
        files[r["doc_id"]] = (r["quern_to"], tuple(r)[:5])
    assert files == {r["doc_id"]: (r["new_shard"], rows[r["doc_id"]]) for r in got if r["rewritten"]}
