"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes, then rewrite affected files.

A shard's documents fall into blocks by a hash of doc_id, so many that half of the slack holds one: their number depends on the
shards and the slack, and not on the data. New shards have room for a number of
bytes each. A flow network (source -> old shards -> new shards -> sink) with integer capacities decides how many bytes
go from where to where: staying costs nothing, leaving costs its bytes. Blocks are then chosen to make up those bytes, and
packed, largest first. Shards that neither lose nor gain a block keep their files. Capacities in numbers of blocks are the
other choice: leaving then costs the shard's mean block, and the smallest blocks leave.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Parameters in production. Old shards are the values of ``by``; slack: room beyond an even share, in units of ``capacity``.
PARAMS = {"by": "source", "n_shards": 24, "block_bytes": None, "slack": 0.02, "capacity": "bytes"}


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], s: int, t: int, amount: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest flow of ``amount`` from s to t; ValueError if there is none.

    Successive shortest paths with potentials. Costs may not be negative.
    """
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, 0]
        cost += [w, -w]
    potential, left = [0.0] * n, amount
    while left:
        dist, via = [math.inf] * n, [-1] * n
        dist[s] = 0.0
        heap = [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in graph[v]:
                if cap[e]:
                    w = d + cost[e] + potential[v] - potential[to[e]]
                    if w < dist[to[e]] - 1e-9:
                        dist[to[e]] = w
                        via[to[e]] = e
                        heapq.heappush(heap, (w, to[e]))
        if dist[t] == math.inf:
            raise ValueError("the new shards can't hold all blocks")
        potential = [p + (d if d < math.inf else 0.0) for p, d in zip(potential, dist, strict=True)]
        push, v = left, t
        while v != s:
            push = min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        left -= push
    return [cap[2 * i + 1] for i in range(len(arcs))]


def plan_transfers(blocks: list[int], mean_bytes: list[float], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, first, last + 1, new shard): the blocks to move, by their rank within the old shard, smallest first.

    blocks[i]: blocks of old shard i, which may stay in new shard i if there is one; room[j]: blocks that new shard j can hold.
    All moves go through one hub node, so that arcs grow with the shards and not with their square.
    """
    old, new = len(blocks), len(room)
    hub, s, t = old + new, old + new + 1, old + new + 2
    arcs, total = [], sum(blocks)
    for i, k in enumerate(blocks):
        arcs.append((s, i, k, 0.0))
        if i < new:
            arcs.append((i, old + i, k, 0.0))
        arcs.append((i, hub, k, mean_bytes[i]))
    for j, k in enumerate(room):
        arcs.append((hub, old + j, k, 0.0))
        arcs.append((old + j, t, k, 0.0))
    flow = min_cost_flow(t + 1, arcs, s, t, total)
    leaving = {a: f for (a, b, _, _), f in zip(arcs, flow, strict=True) if b == hub and f}
    coming = [[b - old, f] for (a, b, _, _), f in zip(arcs, flow, strict=True) if a == hub and f]
    moves, k = [], 0
    for i in sorted(leaving):
        at = 0
        while at < leaving[i]:
            j, f = coming[k]
            n = min(f, leaving[i] - at)
            moves.append((i, at, at + n, j))
            at += n
            coming[k][1] -= n
            if not coming[k][1]:
                k += 1
    return moves


def _pack(shard: np.ndarray, size: np.ndarray, held: list[int], n_shards: int, cap: int) -> np.ndarray | None:
    """The new shard of each block so that none holds more than ``cap`` bytes; None where the blocks left over don't fit."""
    old = len(held)
    hub, s, t = old + n_shards, old + n_shards + 1, old + n_shards + 2
    arcs = []
    for i, k in enumerate(held):
        arcs.append((s, i, k, 0.0))
        if i < n_shards:
            arcs.append((i, old + i, k, 0.0))
        arcs.append((i, hub, k, 1.0))
    for j in range(n_shards):
        # of shards with room, those without files first: nothing of theirs is written twice
        arcs.append((hub, old + j, cap, 0.001 if j < old else 0.0))
        arcs.append((old + j, t, cap, 0.0))
    flow = min_cost_flow(t + 1, arcs, s, t, sum(held))
    leaving = {a: f for (a, b, _, _), f in zip(arcs, flow, strict=True) if b == hub and f}
    coming = {b - old for (a, b, _, _), f in zip(arcs, flow, strict=True) if a == hub and f}
    order = np.lexsort((-size, shard))
    ends = np.searchsorted(shard[order], np.arange(old + 1))
    leave = np.zeros(len(size), dtype=bool)
    for i in range(old):
        mine, need = order[ends[i] : ends[i + 1]], leaving.get(i, 0)
        if i >= n_shards:
            leave[mine] = True
        elif need:
            for k in mine:
                if 0 < size[k] <= need:
                    leave[k] = True
                    need -= int(size[k])
            if need:  # every block that is left is larger: the smallest covers the rest
                leave[[k for k in mine if size[k] and not leave[k]][-1]] = True
    stay = [0] * n_shards
    for i, n in zip(shard[~leave].tolist(), size[~leave].tolist(), strict=True):
        stay[i] += n
    heaps = [[(stay[j] - cap, j) for j in range(n_shards) if (j in coming) == first] for first in (True, False)]
    for h in heaps:
        heapq.heapify(h)
    to = shard.copy()
    gone = np.flatnonzero(leave)
    for k in gone[np.argsort(-size[gone], kind="stable")]:
        heap = next((h for h in heaps if h and -h[0][0] >= size[k]), None)
        if heap is None:
            return None
        used, j = heap[0]
        to[k] = j
        heapq.heapreplace(heap, (used + int(size[k]), j))
    return to


def pack_blocks(shard: np.ndarray, size: np.ndarray, n_old: int, n_shards: int, slack: float) -> tuple[np.ndarray, int]:
    """(new shard of each block, capacity in bytes that holds for every new shard).

    The capacity is an even share of the bytes and ``slack`` of it, or the largest block if that is more; where the blocks
    don't fit it rises in steps from 1% of an even share until they do. An old shard loses the bytes it has over the
    capacity, and less than its smallest remaining block beyond that.
    """
    held = [0] * n_old
    for i, n in zip(shard.tolist(), size.tolist(), strict=True):
        held[i] += n
    share = sum(held) / n_shards
    cap, step = max(math.ceil((1 + slack) * share), int(size.max())), max(1, math.ceil(share / 100))
    while (to := _pack(shard, size, held, n_shards, cap)) is None:
        cap, step = cap + step, math.ceil(step * 1.2)
    return to, cap


def _moved_by_bytes(blocks: DataFrame, n_old: int, n_shards: int, slack: float) -> DataFrame:
    """(quern_shard, quern_block, quern_to) of the blocks that move, decided in one task that holds a row a block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [x for x in parts if len(x)]
        if all_:
            b = pd.concat(all_).sort_values(["quern_shard", "quern_block"]).reset_index(drop=True)
            b["quern_to"], _ = pack_blocks(b["quern_shard"].to_numpy(), b["bytes"].to_numpy(), n_old, n_shards, slack)
            yield b.loc[b["quern_to"] != b["quern_shard"], ["quern_shard", "quern_block", "quern_to"]]

    return blocks.coalesce(1).mapInPandas(run, "quern_shard int, quern_block bigint, quern_to int")


def _moved_by_counts(blocks: DataFrame, n_old: int, n_shards: int, slack: float) -> DataFrame:
    """(quern_shard, quern_block, quern_to) of the blocks that move: the smallest of each shard."""
    per = {r["quern_shard"]: (r["k"], r["bytes"]) for r in blocks.groupBy("quern_shard").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes")).collect()}
    n = [per[i][0] for i in range(n_old)]
    room = [math.ceil((1 + slack) * sum(n) / n_shards)] * n_shards
    moves = plan_transfers(n, [per[i][1] / per[i][0] for i in range(n_old)], room)
    ranges = blocks.sparkSession.createDataFrame(moves or [(-1, 0, 0, -1)], "quern_shard int, first long, last long, quern_to int")
    rank = F.row_number().over(Window.partitionBy("quern_shard").orderBy("bytes", "quern_block")) - 1
    return blocks.withColumn("rank", rank).join(ranges, "quern_shard").where("rank >= first and rank < last").select("quern_shard", "quern_block", "quern_to")


def _block(docs: DataFrame, by: str, shards: DataFrame) -> DataFrame:
    """quern_row, quern_shard and quern_block of each row. The table of shards is broadcast while it is under Spark's threshold."""
    rows = docs.select(common.packed(docs))
    joined = rows.join(shards, F.col(f"quern_row.{by}").eqNullSafe(F.col("name")), "left")
    return joined.select("quern_row", F.col("shard").alias("quern_shard"), F.pmod(F.xxhash64(F.lit(7), F.col("quern_row.doc_id").cast("bigint")), F.col("n_blocks")).alias("quern_block"))


def _bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def reshard(docs: DataFrame, by: str = PARAMS["by"], n_shards: int = PARAMS["n_shards"], block_bytes: int | None = PARAMS["block_bytes"], slack: float = PARAMS["slack"], capacity: str = "blocks") -> DataFrame:
    """Each row as struct quern_row, with quern_shard (old), quern_block, quern_to (new) and quern_rewritten.

    Old shards are numbered by ``by`` in order, null first, and shard k may stay new shard k. With capacity "bytes" each
    new shard takes (1 + slack) * bytes / n_shards bytes, see ``pack_blocks``. Blocks are of about ``block_bytes``, or of half of the
    slack: then there are at most 2 * n_shards / slack of them and one for each old shard. A very long text makes a block larger. With capacity "blocks" it takes ceil((1 + slack) * blocks / n_shards) blocks of whatever size; ties
    between blocks of one size go to the smaller number. A shard whose texts are all empty or null is one block. Rows with
    the same doc_id share a block, and so do rows with a null doc_id, as do repeated rows. An empty table gives no rows.

    The driver holds a row for each shard and pair of shards between which blocks move; blocks stay in tables, with
    capacity "bytes" read by one task. Text isn't shuffled while the table of moved blocks is under Spark's broadcast
    threshold, which Spark checks against its written size.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(by).alias("name")).agg(F.sum(_bytes("text")).alias("bytes"))
    shards = [(r["name"], r["bytes"]) for r in sizes.collect()]
    shards.sort(key=lambda x: (x[0] is not None, x[0]))
    if block_bytes is None:
        block_bytes = max(1, int(max(slack, 1 / 64) * sum(b for _, b in shards) / n_shards / 2))
    counts = [max(1, -(-b // block_bytes)) for _, b in shards]
    # written, so that Spark knows their sizes and needn't shuffle text to join them
    known = common.written(spark.createDataFrame([(name, i, k) for i, ((name, _), k) in enumerate(zip(shards, counts, strict=True))], f"name {dict(docs.dtypes)[by]}, shard int, n_blocks bigint"), "shards")
    blocked = _block(docs, by, known)
    blocks = common.written(blocked.groupBy("quern_shard", "quern_block").agg(F.sum(_bytes("quern_row.text")).alias("bytes")), "blocks")
    decide = {"bytes": _moved_by_bytes, "blocks": _moved_by_counts}[capacity]
    moved = common.written(decide(blocks, len(shards), n_shards, slack), "moves")
    changed = sorted({k for r in moved.select("quern_shard", "quern_to").distinct().collect() for k in r})
    moved = moved.select(F.col("quern_shard").alias("quern_s"), F.col("quern_block").alias("quern_b"), "quern_to")
    out = blocked.join(moved, (F.col("quern_shard") == F.col("quern_s")) & (F.col("quern_block") == F.col("quern_b")), "left").drop("quern_s", "quern_b")
    to = F.coalesce("quern_to", "quern_shard")
    return out.withColumn("quern_to", to).withColumn("quern_rewritten", F.col("quern_to").isin(changed) if changed else F.lit(False))


def resharded(docs: DataFrame, **params: object) -> DataFrame:
    """``reshard`` carried out: its rows, those of affected new shards read from new files.

    Whole rows of affected shards are written to the shared folder, one folder a new shard (quern_to=K), without a shuffle of
    text. Rows of other shards stay in the files that ``docs`` reads and are read from there.
    """
    placed = reshard(docs, **(PARAMS | params))
    names = [c for c in placed.columns if c != "quern_rewritten"]
    new = common.written(placed.where("quern_rewritten").select(*names), "resharded", by="quern_to").select(*names)
    return new.withColumn("quern_rewritten", F.lit(True)).unionByName(placed.where("not quern_rewritten"))


def place(docs: DataFrame, **params: object) -> DataFrame:
    """``docs`` with columns old_shard and new_shard after its own, as ``resharded`` leaves them; an own column of such a name is left out."""
    names = [c for c in docs.columns if c not in ("old_shard", "new_shard")]
    return resharded(docs.select(*(f"`{c}`" for c in names)), **params).select("quern_row.*", F.col("quern_shard").alias("old_shard"), F.col("quern_to").alias("new_shard"))


def rewrite(spark: SparkSession, src: str, dst: str, **params: object) -> list[int]:
    """Reshard the Parquet data set at ``src`` (folders old_shard=K, as ``place`` numbers them) into ``dst`` (folders shard=K).

    Only affected shards are read for their rows and written anew; the files of others are copied as they are. Returns the
    affected shards. Null and empty texts, ties, repeated rows and clashing names are as in ``reshard``; folders decide the old
    shard, and an empty data set has none.
    """
    docs = spark.read.parquet(src)
    p = PARAMS | params | {"by": "old_shard"}
    placed = reshard(docs, **p)
    inner = [c for c in docs.columns if c != "old_shard"]
    changed = sorted(r[0] for r in placed.where("quern_rewritten").select("quern_to").distinct().collect())
    names = {r[0]: r[1] for r in placed.select("quern_shard", "quern_row.old_shard").distinct().collect()}
    lost = sorted(r[0] for r in placed.where("quern_to <> quern_shard").select("quern_shard").distinct().collect())
    affected = sorted({*changed, *lost})
    # rows of affected shards only: the filter on old_shard prunes folders
    placed.where(F.col("quern_row.old_shard").isin([names[i] for i in lost] + [names[i] for i in changed if i in names])).where(F.col("quern_to").isin(affected)).select(*(F.col(f"quern_row.`{c}`") for c in inner), F.col("quern_to").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(dst)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    for i, name in names.items():
        if i not in affected:
            a, b = path(f"{src}/old_shard={name}"), path(f"{dst}/shard={i}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return affected


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return resharded(docs).select("quern_row.doc_id", "quern_row.source", F.col("quern_shard").alias("old_shard"), F.col("quern_block").alias("block"), F.col("quern_to").alias("new_shard"), (F.col("quern_to") != F.col("quern_shard")).alias("moved"), F.col("quern_rewritten").alias("rewritten"))
