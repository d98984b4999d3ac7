"""Benchmark decontamination with suffix arrays over the training texts.

Each task packs the documents it reads into shards of about ``shard_tokens`` tokens, builds a suffix array over each
shard, and finds every suffix of every benchmark item in it by binary search. That yields all maximal verbatim matches
(of word tokens, lower-cased) with their places. Documents with a match of ``min_tokens`` or more are affected.

A match holds nothing but words that occur in the benchmark, so only runs of at least ``min_tokens`` such words can hold
one: the suffix array is built over those runs, which loses no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Parameters in production. test_tokens bounds the benchmark tokens sent to executors at once; a larger benchmark is searched in passes.
PARAMS = {"min_tokens": 8, "shard_tokens": 1_000_000, "test_tokens": 1_000_000}
MATCHES = "doc_id bigint, item_id bigint, n_tokens bigint, doc_token bigint, item_token bigint"


class Test:
    """Benchmark items as token numbers from 1; 0 stands for any word that no item has, and for ends.

    ``tokens`` holds the items one after the other, each followed by a 0; a suffix is its place there. Memory is in proportion
    to the items' tokens, however long one of them is.
    """

    def __init__(self, items: list[tuple[int | None, list[str]]], min_tokens: int):
        self.vocab: dict[str, int] = {}
        items = [(i, w) for i, w in items if len(w) >= min_tokens]
        sizes = np.array([len(w) for _, w in items], dtype=np.int64)
        self.longest = int(sizes.max()) if len(items) else 0
        number = self.vocab.setdefault
        self.tokens = np.zeros(int(sizes.sum()) + len(items), dtype=np.int32)
        begin = np.cumsum(sizes + 1) - sizes - 1
        for at, (_, words) in zip(begin.tolist(), items, strict=True):
            self.tokens[at : at + len(words)] = [number(w, len(self.vocab) + 1) for w in words]
        self.ids = [i for i, _ in items]
        counts = sizes - min_tokens + 1
        self.item = np.repeat(np.arange(len(items)), counts)
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(begin, counts) + self.start
        self.before = np.where(self.start > 0, self.tokens[self.place - 1], 0) if len(items) else np.empty(0, dtype=np.int32)

    def window(self, which: np.ndarray, skip: int, width: int) -> np.ndarray:
        """``width`` tokens of each suffix after its first ``skip``. Rows that run past their end hold tokens of other items after a 0."""
        at = self.place[which][:, None] + np.arange(skip, skip + width)
        return self.tokens[np.minimum(at, len(self.tokens) - 1)]


def suffix_array(s: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of runs in order, by prefix doubling up to ``depth`` tokens. left[i]: tokens to the run's end.

    Ties beyond ``depth``, the longest a benchmark item can reach, stay in order of position.
    """
    n, rank, k = len(s), s.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth and n:
        far = np.minimum(np.arange(n) + k, n - 1)
        second = np.where(left > k, rank[far], 0)
        key = rank * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) + 1
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n:
            break
        k *= 2
    return order


def _window(s: np.ndarray, left: np.ndarray, at: np.ndarray, width: int, skip: int = 0) -> np.ndarray:
    cols = np.arange(skip, skip + width)
    return np.where(cols < left[at][:, None], s[np.minimum(at[:, None] + cols, len(s) - 1)], 0)


def _search(s: np.ndarray, left: np.ndarray, order: np.ndarray, tests: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every row of ``tests`` at once, by its first tokens: the first place not below it, or above it."""
    lo, hi = np.zeros(len(tests), dtype=np.int64), np.full(len(tests), len(order), dtype=np.int64)
    width = tests.shape[1]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        w, q = _window(s, left, order[mid], width), tests[open_]
        differs = w != q
        first = differs.argmax(axis=1)
        r = np.arange(len(open_))
        below = np.where(differs[r, first], w[r, first] < q[r, first], right)
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)


def _reach(s: np.ndarray, left: np.ndarray, at: np.ndarray, test: Test, q: np.ndarray, width: int = 64) -> np.ndarray:
    """How many tokens the shard at ``at`` and the suffixes ``q`` have in common, compared ``width`` at a time."""
    length, going, skip = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), 0
    while len(going):
        w, t = _window(s, left, at[going], width, skip), test.window(q[going], skip, width)
        differs = (w != t) | (t == 0)
        ends = differs.any(axis=1)
        length[going] += np.where(ends, differs.argmax(axis=1), width)
        going, skip = going[~ends], skip + width
    return length


def search_shard(tokens: np.ndarray, bounds: np.ndarray, test: Test, min_tokens: int) -> Iterator[np.ndarray]:
    """Rows (document in the shard, item, length, token in the document, token in the item) of the maximal matches.

    tokens: all documents of the shard, numbered by ``test.vocab`` (0: not in it); bounds[i]: where document i begins.
    """
    known = tokens > 0
    # a run ends at an unknown word and at a document's end
    edge = np.zeros(len(tokens) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = ends - starts >= min_tokens
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts) or not len(test.place):
        return
    offset = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(offset[-1]) - np.repeat(offset[:-1], sizes)
    place = np.repeat(starts, sizes) + inside
    s, left = tokens[place], np.repeat(sizes, sizes) - inside
    order = suffix_array(s, left, test.longest)
    head = test.window(np.arange(len(test.place)), 0, min_tokens)
    lo, hi = _search(s, left, order, head, False), _search(s, left, order, head, True)
    doc = np.searchsorted(bounds, place, side="right") - 1
    hits = hi - lo
    step = 50_000
    upto = np.cumsum(hits)
    done = 0
    while done < (upto[-1] if len(upto) else 0):
        n = np.arange(done, min(done + step, upto[-1]))
        done += len(n)
        q = np.searchsorted(upto, n, side="right")
        at = order[lo[q] + n - (upto[q] - hits[q])]
        previous = np.where(inside[at] > 0, s[at - 1], 0)
        grows = (previous == test.before[q]) & (previous > 0)  # the match one token earlier is longer
        q, at = q[~grows], at[~grows]
        length = _reach(s, left, at, test, q)
        d = doc[at]
        yield np.stack([d, test.item[q], length, place[at] - bounds[d], test.start[q]], axis=1)


def _shards(batches: Iterator[pa.RecordBatch], text: int | str, test: Test, shard_tokens: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches cut into shards by their tokens: (slices of batches, token numbers, bounds of documents)."""
    get, held, parts, bounds, size = test.vocab.get, [], [], [], 0
    for b in common.pieces(batches):
        since = 0
        for i, t in enumerate(b.column(text).to_pylist()):
            words = common.WORD.findall(t.lower()) if t else ()
            bounds.append(size)
            parts.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)))
            size += len(words)
            if size >= shard_tokens:
                held.append(b.slice(since, i + 1 - since))
                yield held, np.concatenate(parts), np.array(bounds, dtype=np.int64)
                held, parts, bounds, size, since = [], [], [], 0, i + 1
        if since < b.num_rows:
            held.append(b.slice(since))
    if held:
        yield held, np.concatenate(parts), np.array(bounds, dtype=np.int64)


def passes(benchmark: DataFrame, min_tokens: int, test_tokens: int) -> Iterator[Test]:
    """The benchmark, read piece by piece, as tests of at most ``test_tokens`` tokens (one longer item makes one test)."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), "text").where("text is not null").toLocalIterator():
        words = common.WORD.findall(r[1].lower())
        if held and size + len(words) > test_tokens:
            yield Test(held, min_tokens)
            held, size = [], 0
        held.append((r[0], words))
        size += len(words)
    if held:
        yield Test(held, min_tokens)


def _best(rows: np.ndarray) -> np.ndarray:
    """Of each (document, item) the longest match; among those the first in the document, then in the item."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows


def matches(docs: DataFrame, benchmark: DataFrame, min_tokens: int = PARAMS["min_tokens"], shard_tokens: int = PARAMS["shard_tokens"], test_tokens: int = PARAMS["test_tokens"]) -> DataFrame:
    """(doc_id, item_id, n_tokens, doc_token, item_token): the longest verbatim match of each document row and item.

    Tokens count from 0. Ties go to the first place in the document, then in the item. Items under ``min_tokens`` tokens
    can't match and aren't searched. Null and empty texts match nothing; repeated rows and null ids give rows of their
    own; other columns are ignored, whatever their names. Texts and items of any length are searched whole. An empty table on
    either side gives no rows. No shuffle.
    """
    out = None
    for test in passes(benchmark, min_tokens, test_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(test)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for held, tokens, bounds in _shards(batches, "text", t, shard_tokens):
                found = list(search_shard(tokens, bounds, t, min_tokens))
                if not found:
                    continue
                rows = _best(np.concatenate(found))
                ids = pa.concat_arrays([h.column("doc_id") for h in held])
                yield pa.record_batch({"doc_id": ids.take(pa.array(rows[:, 0])), "item_id": pa.array([t.ids[i] for i in rows[:, 1]], pa.int64()), "n_tokens": pa.array(rows[:, 2]), "doc_token": pa.array(rows[:, 3]), "item_token": pa.array(rows[:, 4])})

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_tokens: int = PARAMS["min_tokens"], shard_tokens: int = PARAMS["shard_tokens"], test_tokens: int = PARAMS["test_tokens"]) -> DataFrame:
    """``docs`` without the rows that ``matches`` would list, all columns kept. One narrow stage a pass: no join, no shuffle.

    Null and empty texts stay, repeated rows stay or go together, an empty benchmark removes nothing, and columns may have any
    names; all else is as in ``matches``.
    """
    text = docs.columns.index("text")
    schema = docs.schema
    for test in passes(benchmark, min_tokens, test_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(test)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for held, tokens, bounds in _shards(batches, text, t, shard_tokens):
                clean = np.ones(len(bounds), dtype=bool)
                for rows in search_shard(tokens, bounds, t, min_tokens):
                    clean[rows[:, 0]] = False
                at = 0
                for h in held:
                    yield h.filter(pa.array(clean[at : at + h.num_rows]))
                    at += h.num_rows

        docs = docs.mapInArrow(run, schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), **PARAMS)


SQL = f"""
with dt as (select doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as w from documents),
it as (select item_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as w from benchmark),
dg as (select doc_id, i - 1 as p, array_to_string(w[i : i + {PARAMS["min_tokens"] - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {PARAMS["min_tokens"] - 2})) as i from dt where len(w) >= {PARAMS["min_tokens"]})),
ig as (select item_id, i - 1 as q, array_to_string(w[i : i + {PARAMS["min_tokens"] - 1}], ' ') as g from (select item_id, w, unnest(range(1, len(w) - {PARAMS["min_tokens"] - 2})) as i from it where len(w) >= {PARAMS["min_tokens"]})),
m as (select doc_id, item_id, p, q, p - row_number() over (partition by doc_id, item_id, p - q order by p) as island from dg join ig using (g)),
runs as (select doc_id, item_id, min(p)::bigint as doc_token, min(q)::bigint as item_token, (count(*) + {PARAMS["min_tokens"] - 1})::bigint as n_tokens from m group by doc_id, item_id, p - q, island),
best as (select *, row_number() over (partition by doc_id, item_id order by n_tokens desc, doc_token, item_token) as r from runs)
select doc_id, item_id, n_tokens, doc_token, item_token from best where r = 1"""
