"""Jaccard self-join of documents by their sets of word n-grams, with prefixes of token combinations.

The tokens of the join are n-grams, as 64-bit hashes. Over all documents, exact document frequencies put them in one
global order, rarest first, and in classes: rare ones are class 1 and are indexed singly, more frequent ones are class 2 and
are indexed by pairs, the most frequent ones class 3, by triples. Let a set have n tokens and need at least o of them in common
with any partner. A prefix of single tokens would be n - o + 1 long; it is extended until
P - min(n2, 1) - min(n3, 2) >= n - o + 1, where n2 and n3 of its P tokens are of class 2 and 3: of two sets that reach the
threshold, the one whose prefix ends first has that many tokens of it in common with the other, so that they share a class-1
token, two of class 2 or three of class 3.

Combinations are many in large sets, so the largest size of combination depends on a set's size (``tiers``) and, as the extension
must fit in the set, on its overlap. A pair is found by the scheme of its larger set: a set is indexed by the scheme of
every size that a larger partner can have, which is one or two schemes. Candidates are verified on their full sets. Nothing is
capped or sampled.

How it runs:

1. *Frequencies.* Each map task hashes its documents and sends packed arrays of hashes to buckets of the hash range; a
   bucket counts each n-gram and sends those of frequency 2 or more home to their document. N-grams of one document
   alone take part only by their number. One shuffle of 8 bytes an n-gram.
2. *Survivors.* A document whose n-grams of frequency 2 or more are under o can't have a partner and ends here. Of
   identical sets, found by a 128-bit digest, the first row goes on with their number.
3. *Lists.* Sets post their signatures; each signature's sets form a list. A list goes to its first set ("owner"), so that the
   many signatures that copies of one text share meet in one place and a pair is verified once there, not once a
   signature. A list of more than ``CHUNK`` sets is cut into pieces by row, and each two of the pieces go to a place of their own.
4. *Verification.* Sets are sent to the buckets that list them, and each pair that shares a list is verified. The pairs
   go, packed, to a bucket by their smaller row, which tells repeated ones apart, sums up the links of each set and leaves of
   the pairs a forest that connects the same sets.

Packed arrays are read and written by numpy in Arrow batches: built-in operators would need a row, and a shuffle record,
for every one of the n-grams.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Parameters in production. permille: the Jaccard threshold in thousandths; limits: the greatest document frequencies of class 1
#: and 2, None for the powers 1/2 and 3/4 of the number of documents; tiers: the largest sets indexed by triples and by pairs.
PARAMS = {"n": 3, "permille": 600, "limits": None, "tiers": (32, 128)}
CHUNK = 1024
#: Bytes of input for each bucket beyond the shuffle partitions that are set.
SLOT_BYTES = 256 << 20
BLOCK = 1_500_000  # n-grams that a map task packs at a time
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, n: int, memo: common.Hashes) -> np.ndarray:
    """Sorted hashes of the word n-grams of a text; of all its words as one when they are fewer than n."""
    words = common.WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    g = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        g = _mix(g * _C[0] + h[i : len(h) - n + 1 + i])
    return np.unique(g)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    """Part of the hash range, 0 to slots - 1."""
    return ((h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _order(keys: np.ndarray) -> np.ndarray:
    """argsort of 64-bit hashes by sorting hash and place in one number, which is several times faster."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    packed = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    a = keys[order]
    if len(a) and ((a[1:] >> bits == a[:-1] >> bits) & (a[1:] != a[:-1])).any():
        return np.argsort(keys, kind="stable")
    return order


def _firsts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, dtype=np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(x.nbytes for x in arrays)], dtype=np.int64)
    return b"".join([sizes.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    k = len(types)
    sizes = np.frombuffer(blob, dtype=np.int64, count=k + 1)[1:]
    out, at = [], 8 * (k + 1)
    for size, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(blob, dtype=t, count=size // np.dtype(t).itemsize, offset=at))
        at += size
    return out


def _packets(slots: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"slot": pa.array(slots, pa.int32()), "blob": pa.array(blobs, pa.binary())})


PACKET = "slot int, blob binary"


def _flat(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _send_runs(slot: np.ndarray, heads: list[np.ndarray], lengths: np.ndarray, bodies: list[np.ndarray], slots: int) -> Iterator[pa.RecordBatch]:
    """As _send for entries that have a run of values each: packets hold heads, lengths and the runs one after the other."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(slot, kind="stable")
    at = np.searchsorted(slot[order], np.arange(slots + 1))
    used = np.flatnonzero(at[1:] > at[:-1])
    for k in range(0, len(used), 256):
        blobs = []
        for s in used[k : k + 256]:
            e = order[at[s] : at[s + 1]]
            f = _flat(lengths[e], starts[e])
            blobs.append(_pack(*(h[e] for h in heads), lengths[e].astype(np.uint32), *(b[f] for b in bodies)))
        yield _packets([int(s) for s in used[k : k + 256]], blobs)


def _post(batches: Iterator[pa.RecordBatch], files: dict[str, int], n: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Documents -> packets of (row, set size, run of hashes) for each part of the hash range."""
    memo = common.Hashes()
    rows, sets, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not sets:
            return
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
        slot = _slot(h, slots)  # ascending within a document, as its hashes are
        first = _firsts(doc * slots + slot)
        lengths = np.diff(np.append(first, len(h)))
        d = doc[first]
        yield from _send_runs(slot[first], [np.array(rows, dtype=np.int64)[d], counts[d].astype(np.uint32)], lengths, [h], slots)

    for b in common.pieces(batches):
        where = common.addresses(files, b.column("path"), b.column("row"))
        for r, t in zip(where.tolist(), b.column("text").to_pylist(), strict=True):
            g = gram_set(t, n, memo)
            if len(g):
                rows.append(r)
                sets.append(g)
                size += len(g)
            if size >= BLOCK:
                yield from flush()
                rows, sets, size = [], [], 0
    yield from flush()


def _gather(batches: Iterator[pa.RecordBatch], *types: type) -> list[np.ndarray]:
    parts = [_unpack(blob, *types) for b in batches for blob in b.column("blob").to_pylist()]
    return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.empty(0, dtype=t) for t in types]


def _home(rows: np.ndarray, slots: int) -> np.ndarray:
    return _slot(_mix(rows.astype(np.uint64) + _C[0]), slots)


def frequency_code(df: np.ndarray) -> np.ndarray:
    """Document frequency as 8 steps a doubling, in a byte. Equal n-grams have equal codes, so any rounding keeps the order global."""
    return np.minimum(255, np.round(8 * np.log2(df))).astype(np.uint8)


def _count(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """One part of the hash range: frequencies, and each document's n-grams of frequency 2 or more sent home."""
    row, n, lengths, h = _gather(batches, np.int64, np.uint32, np.uint32, np.uint64)
    if not len(h):
        return
    entry = np.repeat(np.arange(len(row), dtype=np.uint32), lengths)
    order = _order(h)
    first = _firsts(h[order])
    df = np.diff(np.append(first, len(h)))
    shared = np.repeat(df >= 2, df)
    at = order[shared]
    code = np.zeros(len(h), dtype=np.uint8)
    code[at] = frequency_code(np.repeat(df, df)[shared])
    keep = np.flatnonzero(code)
    if not len(keep):
        return
    e = entry[keep]
    first = _firsts(e)
    d = e[first]
    yield from _send_runs(_home(row[d], slots), [row[d], n[d]], np.diff(np.append(first, len(keep))), [h[keep], code[keep]], slots)


SURVIVOR = "row bigint, n int, same binary, grams binary, codes binary"


def need(n: np.ndarray | int, permille: int) -> np.ndarray | int:
    """Least overlap of a set of n with any partner: ceil(t * n)."""
    return -(-n * permille // 1000)


def _survive(batches: Iterator[pa.RecordBatch], permille: int) -> Iterator[pa.RecordBatch]:
    """One home: documents that can have a partner, their shared n-grams in global order (frequency code, hash).

    same: a digest of the set for documents without an n-gram of their own; others equal no other document.
    """
    row, n, lengths, h, code = _gather(batches, np.int64, np.uint32, np.uint32, np.uint64, np.uint8)
    if not len(row):
        return
    docs, index = np.unique(row, return_inverse=True)
    have = np.bincount(index, weights=lengths).astype(np.int64)
    size = np.zeros(len(docs), dtype=np.int64)
    size[index] = n
    ok = have >= need(size, permille)
    posting = ok[np.repeat(index, lengths)]
    d = np.repeat(index, lengths)[posting]
    h, code = h[posting], code[posting]
    order = np.lexsort((h, code, d))
    d, h, code = d[order], h[order], code[order]
    first = np.append(_firsts(d), len(d))
    rows: list[tuple] = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        i = d[a]
        g = h[a:b]
        rows.append((int(docs[i]), int(size[i]), xxhash.xxh3_128_digest(np.sort(g).tobytes()) if b - a == size[i] else None, g.tobytes(), code[a:b].tobytes()))
        if len(rows) == 2000:
            yield _survivors(rows)
            rows = []
    if rows:
        yield _survivors(rows)


def _survivors(rows: list[tuple]) -> pa.RecordBatch:
    types = {"row": pa.int64(), "n": pa.int32(), "same": pa.binary(), "grams": pa.binary(), "codes": pa.binary()}
    return pa.record_batch({k: pa.array(c, t) for (k, t), c in zip(types.items(), zip(*rows, strict=True), strict=True)})


@lru_cache(maxsize=65536)
def schemes(n: int, permille: int, tiers: tuple[int, int]) -> dict[int, int]:
    """Schemes (largest combination) by which a set of n is indexed, each with the least overlap with partners found by it."""
    out: dict[int, int] = {}
    for m in range(n, n * 1000 // permille + 1) if n <= tiers[1] else (n,):
        o = int(need(m, permille))
        k = 3 if m <= tiers[0] and o >= 4 else 2 if m <= tiers[1] and o >= 2 else 1
        out.setdefault(k, o)
    return out


def signatures(n: int, grams: np.ndarray, codes: np.ndarray, permille: int, limits: tuple[int, int], tiers: tuple[int, int]) -> np.ndarray:
    """Signatures of a set of n, of which ``grams`` (in global order) occur in other documents too."""
    own = n - len(grams)
    ends = np.searchsorted(codes, frequency_code(np.array(limits)), side="right")  # where class 1 and 2 end
    out = []
    for k, o in schemes(n, permille, tiers).items():
        least = n - o + 1
        length = max(0, least - own)
        while True:
            bounds = [0, *(min(length, int(e)) for e in ends[: k - 1]), length]
            if own + length - sum(min(bounds[c + 1] - bounds[c], c) for c in range(1, k)) >= least:
                break
            length += 1
        for c in range(k):
            part = grams[bounds[c] : bounds[c + 1]]
            if len(part) > c:
                at = np.arange(len(part))[None] if c == 0 else np.array(np.triu_indices(len(part), 1)) if c == 1 else np.array(list(combinations(range(len(part)), 3))).T
                h = np.full(at.shape[1], 4 * k + c, dtype=np.uint64)
                for x in at:
                    h = _mix(h * _C[0] + part[x])
                out.append(h)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch], permille: int, limits: tuple[int, int], tiers: tuple[int, int], slots: int) -> Iterator[pa.RecordBatch]:
    """Sets -> packets of (row, run of signatures)."""
    for b in batches:
        rows = np.asarray(b.column("row"))
        sigs = [np.unique(signatures(n, np.frombuffer(g, dtype=np.uint64), np.frombuffer(c, dtype=np.uint8), permille, limits, tiers)) for n, g, c in zip(*(b.column(k).to_pylist() for k in ("n", "grams", "codes")), strict=True)]
        counts = np.array([len(s) for s in sigs], dtype=np.int64)
        if not counts.sum():
            continue
        h, doc = np.concatenate(sigs), np.repeat(np.arange(len(sigs)), counts)
        slot = _slot(h, slots)
        first = _firsts(doc * slots + slot)
        yield from _send_runs(slot[first], [rows[doc[first]]], np.diff(np.append(first, len(h))), [h], slots)


def _list(batches: Iterator[pa.RecordBatch], slots: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """One part of the signatures: packets of (place, sets of the first piece, run of sets). Without a second piece the first is 0."""
    row, lengths, h = _gather(batches, np.int64, np.uint32, np.uint64)
    if not len(h):
        return
    entry = np.repeat(np.arange(len(row)), lengths)
    order = _order(h)
    first = _firsts(h[order])
    df = np.diff(np.append(first, len(h)))
    multi = np.repeat(df >= 2, df)
    group, r = np.repeat(np.arange(len(df)), df)[multi], row[entry[order[multi]]]
    order = np.lexsort((r, group))
    group, r = group[order], r[order]
    first = _firsts(group)
    if not len(first):
        return
    size = np.diff(np.append(first, len(group)))
    # the same list under many signatures is sent once
    key = np.add.reduceat(_mix(r.astype(np.uint64) + _C[0]), first)
    _, pick = np.unique(np.stack([key, r[first].astype(np.uint64), size.astype(np.uint64)], axis=1), axis=0, return_index=True)
    first, size = first[pick], size[pick]
    owner = r[first].astype(np.uint64)
    whole = size <= chunk
    place = _mix(owner + _C[0])
    yield from _send_runs(_slot(place[whole], slots), [place[whole], np.zeros(whole.sum(), dtype=np.uint32)], size[whole], [r[_flat(size[whole], first[whole])]], slots)
    for at, k, o in zip(first[~whole], size[~whole], owner[~whole], strict=True):
        mine = r[at : at + k]
        bits = np.uint64(int(-(-int(k) // chunk) - 1).bit_length())
        piece = _mix(mine.astype(np.uint64) + _C[1]) >> (np.uint64(64) - bits)
        parts = [mine[piece == x] for x in range(1 << int(bits))]
        for i, a in enumerate(parts):
            pairs = [(j, parts[j]) for j in range(i, len(parts)) if len(a) and len(parts[j])]
            if pairs:
                where = _mix(_mix(_mix(np.full(len(pairs), o) + bits) * _C[0] + np.uint64(i)) * _C[0] + np.array([j for j, _ in pairs], dtype=np.uint64))
                runs = [a if j == i else np.concatenate([a, b]) for j, b in pairs]
                yield from _send_runs(_slot(where, slots), [where, np.array([0 if j == i else len(a) for j, _ in pairs], dtype=np.uint32)], np.array([len(x) for x in runs], dtype=np.int64), [np.concatenate(runs)], slots)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that a packet of lists names, once each."""
    for b in batches:
        for slot, blob in zip(b.column("slot").to_pylist(), b.column("blob").to_pylist(), strict=True):
            rows = np.unique(_unpack(blob, np.uint64, np.uint32, np.uint32, np.int64)[3])
            yield pa.record_batch({"slot": pa.array(np.full(len(rows), slot, dtype=np.int32)), "row": pa.array(rows)})


def _verify_place(lists: list[tuple[np.ndarray, np.ndarray]], sets: dict[int, tuple[int, int, np.ndarray]], permille: int) -> list[np.ndarray]:
    """Pairs (row, row, overlap) of one place that share a list and reach the threshold. lists: the two sides of each list."""
    docs = np.unique(np.concatenate([x for pair in lists for x in pair]))
    m = len(docs)
    n = np.array([sets[d][0] for d in docs.tolist()], dtype=np.int64)
    grams = [sets[d][2] for d in docs.tolist()]
    at = [(np.searchsorted(docs, x), np.searchsorted(docs, y)) for x, y in lists]
    out = []
    if m < 12:
        pairs = {(min(i, j), max(i, j)) for x, y in at for i in x.tolist() for j in y.tolist() if i != j}
        keep = [(i, j) for i, j in pairs if min(n[i], n[j]) * 1000 >= permille * max(n[i], n[j])]
        frozen = {i: frozenset(grams[i].tolist()) for i in {x for p in keep for x in p}}
        for i, j in keep:
            both = len(frozen[i] & frozen[j])
            if both * 1000 >= permille * (n[i] + n[j] - both):
                out.append(np.array([[docs[i], docs[j], both]], dtype=np.int64))
        return out
    # columns: n-grams of at least two of the documents
    values, inverse, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    column = np.cumsum(times >= 2) - 1
    who = np.repeat(np.arange(m), [len(g) for g in grams])
    useful = times[inverse] >= 2
    who, col, width = who[useful], column[inverse[useful]], int((times >= 2).sum())
    step = max(1, min(m, 1024))
    starts = np.searchsorted(who, np.arange(m + 1))

    def block(a: int, b: int, c0: int, c1: int) -> np.ndarray:
        x = np.zeros((b - a, c1 - c0), dtype=np.float32)
        w, c = who[starts[a] : starts[b]], col[starts[a] : starts[b]]
        in_ = (c >= c0) & (c < c1)
        x[w[in_] - a, c[in_] - c0] = 1
        return x

    for a in range(0, m, step):
        b = min(m, a + step)
        for a2 in range(a, m, step):
            b2 = min(m, a2 + step)
            listed = np.zeros((b - a, b2 - a2), dtype=bool)
            for x, y in at:
                for p, q in ((x, y), (y, x)) if x is not y else ((x, y),):
                    p, q = p[(p >= a) & (p < b)] - a, q[(q >= a2) & (q < b2)] - a2
                    if len(p) and len(q):
                        listed[np.ix_(p, q)] = True
            if a == a2:
                listed &= np.triu(np.ones(listed.shape, dtype=bool), 1)
            if not listed.any():
                continue
            both = np.zeros(listed.shape, dtype=np.float64)
            for c0 in range(0, width, 8192):
                c1 = min(width, c0 + 8192)
                both += block(a, b, c0, c1) @ block(a2, b2, c0, c1).T
            union = n[a:b][:, None] + n[a2:b2][None, :] - both
            i, j = np.nonzero(listed & (both * 1000 >= permille * union))
            out.append(np.stack([docs[a + i], docs[a2 + j], both[i, j].astype(np.int64)], axis=1))
    return out


_PAIR = [np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.int64]


def _verify(lists: pa.Table, sets: pa.Table, permille: int, slots: int) -> pa.Table:
    """One bucket of places: packets of pairs (row, row, overlap, sizes, numbers of identical sets), by the smaller row."""
    have = {r: (n, t, np.frombuffer(g, dtype=np.uint64)) for r, n, t, g in zip(*(sets.column(k).to_pylist() for k in ("row", "n", "times", "grams")), strict=True)}
    places: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for blob in lists.column("blob").to_pylist():
        place, left, lengths, rows = _unpack(blob, np.uint64, np.uint32, np.uint32, np.int64)
        for k, cut, x in zip(place.tolist(), left.tolist(), np.split(rows, np.cumsum(lengths)[:-1]), strict=True):
            places.setdefault(k, []).append((x[:cut], x[cut:]) if cut else (x, x))
    found = [x for own in places.values() for x in _verify_place(own, have, permille)]
    p = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    order = np.lexsort((p[:, 1], p[:, 0]))
    p = p[order]
    p = p[np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(axis=1)])] if len(p) else p
    slot = _home(p[:, 0], slots)
    order = np.argsort(slot, kind="stable")
    p, slot = p[order], slot[order]
    first = np.append(_firsts(slot), len(slot))
    of = lambda rows, i: [have[x][i] for x in rows.tolist()]
    blobs = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        x, y = p[a:b, 0], p[a:b, 1]
        columns = [x, y, p[a:b, 2], of(x, 0), of(y, 0), of(x, 1), of(y, 1)]
        blobs.append(_pack(*(np.asarray(c, dtype=t) for c, t in zip(columns, _PAIR, strict=True))))
    return pa.table({"slot": pa.array(slot[first[:-1]].astype(np.int32)), "blob": pa.array(blobs, pa.binary())})


LINKS = "row bigint, links bigint, best double, root bigint"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of pairs: for each set its links and greatest similarity there, and the smallest row that these pairs connect it to."""
    a, b, both, na, nb, ta, tb = _gather(batches, *_PAIR)
    if not len(a):
        return
    order = np.lexsort((b, a))
    once = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])]
    a, b, both, na, nb, ta, tb = (x[once] for x in (a, b, both.astype(np.int64), na.astype(np.int64), nb.astype(np.int64), ta, tb))
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    links = np.zeros(len(rows), dtype=np.int64)
    np.add.at(links, i, tb)
    np.add.at(links, j, ta)
    similar, best = both / (na + nb - both), np.zeros(len(rows))
    np.maximum.at(best, i, similar)
    np.maximum.at(best, j, similar)
    root = np.arange(len(rows))
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = root[root]
        if (root == before).all():
            break
    yield pa.record_batch({"row": pa.array(rows), "links": pa.array(links), "best": pa.array(best), "root": pa.array(rows[root])})


def _slots(spark: SparkSession, size: int) -> int:
    """Buckets for an input of ``size`` bytes: a worker holds one at a time, so their number follows the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLOT_BYTES))


def _collect_garbage(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished stages now: they would lie on the executors' disks until the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_classes(docs: DataFrame, files: common.Files, n: int, permille: int, limits: tuple[int, int] | None, tiers: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """A written table (row, root, links, best) of the rows that are similar to another: the smallest row of the class (connected
    component), the number of similar rows and the greatest similarity. docs must be from ``common.addressed``."""
    spark = docs.sparkSession
    slots = _slots(spark, files.bytes)
    if limits is None:
        count = docs.count()
        limits = (max(2, round(count**0.5)), max(4, round(count**0.75)))
    tiers = tuple(tiers)
    rows = docs.select("text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    posted = rows.mapInArrow(lambda b: _post(b, files, n, slots), PACKET).repartitionById(slots, F.col("slot"))
    home = posted.mapInArrow(lambda b: _count(b, slots), PACKET).repartitionById(slots, F.col("slot"))
    survivors = common.written(home.mapInArrow(lambda b: _survive(b, permille), SURVIVOR), "survivors")
    del posted, home
    _collect_garbage(spark)
    # of identical sets one goes on
    same = survivors.where("same is not null").select("row", "n", "same")
    firsts = common.written(same.groupBy("same", "n").agg(F.min("row").alias("first"), F.count("*").alias("times")), "firsts")
    columns = ["row", "n", "times", "grams", "codes"]
    alone = survivors.where("same is null").withColumn("times", F.lit(1).cast("bigint")).select(*columns)
    sets = common.written(alone.unionByName(survivors.where("same is not null").join(firsts.select(F.col("first").alias("row"), "times"), "row").select(*columns)), "sets")
    copies = common.written(same.join(firsts.where("times > 1"), ["same", "n"]).select("row", "first"), "copies")
    common.drop(survivors)
    signed = sets.mapInArrow(lambda b: _sign(b, permille, limits, tiers, slots), PACKET).repartitionById(slots, F.col("slot"))
    lists = common.written(signed.mapInArrow(lambda b: _list(b, 4 * slots, chunk), PACKET), "lists")
    members = lists.mapInArrow(_members, "slot int, row bigint").distinct()
    listed = members.join(sets.select("row", "n", "times", "grams"), "row")
    pairs = lists.groupBy("slot").cogroup(listed.groupBy("slot")).applyInArrow(lambda a, b: _verify(a, b, permille, slots), PACKET)
    links = common.written(pairs.repartitionById(slots, F.col("slot")).mapInArrow(_settle, LINKS), "links")
    common.drop(sets, lists)
    roots = components(links.select(F.col("row").alias("a"), F.col("root").alias("b")))
    # every set that is similar to another or has copies, with what is known of it
    known = links.groupBy("row").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    known = known.join(firsts.where("times > 1").select(F.col("first").alias("row"), "times"), "row", "full").join(roots, "row", "left")
    one = F.coalesce("times", F.lit(1))
    known = known.select(F.col("row").alias("first"), F.coalesce("root", "row").alias("root"), (F.coalesce("links", F.lit(0)) + one - 1).alias("links"), F.when(one > 1, 1.0).otherwise(F.col("best")).alias("best"))
    found = known.join(copies, "first", "left").select(F.coalesce("row", "first").alias("row"), "root", "links", "best")
    out = common.written(found, "classes")
    common.drop(links, firsts, copies, roots)
    return out


def _ids(docs: DataFrame, files: dict[str, int]) -> DataFrame:
    """(row, doc_id) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"row": pa.array(common.addresses(files, b.column("path"), b.column("at"))), "doc_id": b.column("doc_id")})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")).mapInArrow(run, "row bigint, doc_id bigint")


def join(docs: DataFrame, n: int = PARAMS["n"], permille: int = PARAMS["permille"], limits: tuple[int, int] | None = PARAMS["limits"], tiers: tuple[int, int] = PARAMS["tiers"], chunk: int = CHUNK) -> DataFrame:
    """(doc_id, class_id, n_links, best_jaccard) of each row of ``docs``.

    n_links: how many other rows have a Jaccard similarity of permille / 1000 or more with this one, identical sets counted one
    by one; best_jaccard: the greatest of these similarities, 0 without any. A class is a connected component of
    these links; class_id is its smallest doc_id, null where it has none. Thus a group of copies takes a row for each, and not one for
    every two. Texts that are null or have no word are similar to none and alone in their class. A text of under n words is
    one n-gram. Repeated rows are similar to each other. Very long texts count whole. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    docs, files = common.addressed(docs)
    classes = row_classes(docs, files, n, permille, limits, tiers, chunk)
    named = _ids(docs, files).join(classes, "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = named.where("links is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best_jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(row, root), a written table: the smallest row of each row's connected component, from edges (a, b), for all rows but the roots.

    Alternating large-star and small-star steps until nothing changes, about the logarithm of the longest path; each round's
    edges are a written table, so lineage stays short, and the one before is deleted. Null ends and edges from a row to itself
    are passed over; without edges there are no rows.
    """
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, edges = edges, common.written(small, "edges")
        common.drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("a").alias("row"), F.col("b").alias("root"))
            out.quern_path = edges.quern_path
            return out
        before = now


def keep_one(docs: DataFrame, n: int = PARAMS["n"], permille: int = PARAMS["permille"], limits: tuple[int, int] | None = PARAMS["limits"], tiers: tuple[int, int] = PARAMS["tiers"], chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each class of ``join``, all columns kept.

    The row with the smallest doc_id stays; of several with that id, or where all are null, the first in the input's files. Rows
    without any word are alone in their class and stay. Texts of any length count whole; a table without rows stays so; columns
    of the input may have any names.
    """
    docs, files = common.addressed(docs)
    classes = row_classes(docs, files, n, permille, limits, tiers, chunk)
    named = classes.select("row", "root").join(_ids(docs, files), "row")
    chosen = named.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("stays"))
    gone = named.join(chosen, "root").where("row <> stays").select("row")
    paths = docs.sparkSession.createDataFrame([(i, p) for p, i in files.items()] or [(-1, "")], "file int, quern_path string")
    gone = common.written(gone.select(F.shiftright("row", common.ROW_BITS).cast("int").alias("file"), F.col("row").bitwiseAND((1 << common.ROW_BITS) - 1).alias("quern_row_at")).join(paths, "file").select("quern_path", "quern_row_at"), "gone")
    common.drop(classes)
    _collect_garbage(docs.sparkSession)
    out = docs.select(common.packed(docs), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    return out.join(gone, (F.col("path") == F.col("quern_path")) & (F.col("at") == F.col("quern_row_at")), "left_anti").select("quern_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), **PARAMS)


SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) <= {PARAMS["n"]} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {PARAMS["n"] - 2}), lambda i: array_to_string(w[i : i + {PARAMS["n"] - 1}], ' ')) end)) as g from w where len(w) > 0),
u as materialized (select g, min(doc_id) as id, count(*) as times, list(doc_id) as ids from s group by g),
e as materialized (select id, times, len(g) as n, unnest(g) as gram from u),
p as (select a.id as a, b.id as b, a.n as na, b.n as nb, any_value(a.times) as ta, any_value(b.times) as tb, count(*) as overlap from e a join e b on a.gram = b.gram and a.id < b.id group by a.id, b.id, a.n, b.n),
near as materialized (select *, overlap / (na + nb - overlap) as jaccard from p where overlap * 1000 >= {PARAMS["permille"]} * (na + nb - overlap)),
ends as materialized (select a, b, tb as t, jaccard from near union all select b, a, ta, jaccard from near),
linked as (select a, sum(t) as links, max(jaccard) as best from ends group by a),
reach(id, root) as (select id, id from u union select x.b, r.root from reach r join ends x on x.a = r.id where r.root < x.b),
roots as (select id, min(root) as root from reach group by id),
known as (select unnest(u.ids) as doc_id, r.root, coalesce(l.links, 0) + u.times - 1 as links, case when u.times > 1 then 1.0 else coalesce(l.best, 0.0) end as best
    from u join roots r on r.id = u.id left join linked l on l.a = u.id)
select d.doc_id, coalesce(k.root, d.doc_id) as class_id, coalesce(k.links, 0)::bigint as n_links, round(coalesce(k.best, 0.0), 6)::double as best_jaccard
from documents d left join known k on k.doc_id = d.doc_id"""
