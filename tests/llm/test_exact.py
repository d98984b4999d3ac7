import random

from pyspark.sql import functions as F

from quern.llm import exact
from tests.llm.conftest import EDGES


def check(spark, path, rows, **kw):
    """Each text has one row that isn't a duplicate, and all its rows name it."""
    got = exact.dedup(spark, path, **kw).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    by = {}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        by.setdefault(text[r["doc_id"]], []).append(r)
    for t, group in by.items():
        if t is None:
            assert all(not r["duplicate"] and r["keep_id"] == r["doc_id"] for r in group)
        else:
            assert sum(not r["duplicate"] for r in group) == 1 and len({r["keep_id"] for r in group}) == 1
            assert all(text[r["keep_id"]] == t for r in group)
    return got


def corpus():
    r = random.Random(4)
    return [(i, r.choice([None, ""] + [f"text {k}" for k in range(25)])) for i in range(150)]


def test_one_batch_keeps_smallest_id(spark, table):
    rows = corpus()
    got = check(spark, table(rows, files=3), rows, files_per_batch=99)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert all(r["keep_id"] == first[dict(rows)[r["doc_id"]]] for r in got if dict(rows)[r["doc_id"]] is not None)


def test_batches_share_state(spark, table):
    rows = corpus()
    check(spark, table(rows, files=4), rows, files_per_batch=1)


def test_full_bytes_are_compared(spark, table):
    """With a digest that collides all the time the result is the same."""
    rows = corpus()
    got = check(spark, table(rows, files=3), rows, files_per_batch=1, digest=lambda c: F.substring(F.sha2(F.col(c), 256), 1, 1).cast("binary"))
    assert sum(not r["duplicate"] for r in got) == len({t for _, t in rows if t is not None}) + sum(t is None for _, t in rows)


def test_edges(spark, table):
    got = exact.dedup(spark, table(EDGES)).collect()
    assert len(got) == len(EDGES)
    copies = [r for r in got if r["keep_id"] == 3 and (r["doc_id"] in (3, None))]
    assert len(copies) == 3 and sum(r["duplicate"] for r in copies) == 2
    assert exact.dedup(spark, table([])).count() == 0
    settings = [spark.conf.get(k, None) for k in exact._STATE]
    assert "RocksDB" not in str(settings[0])


def test_second_delivery_meets_the_first(spark, table, tmp_path):
    """A named state outlives the call: new files are held against what was kept, old ones aren't streamed again."""
    folder = tmp_path / "docs"
    parts = [[(10, "a"), (11, "b"), (12, "a"), (13, None)], [(1, "a"), (2, "c"), (3, "c"), (4, "")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(folder / f"d{k}"))
        got = {r["doc_id"]: (r["keep_id"], r["duplicate"]) for r in exact.dedup(spark, f"{folder}/d*", state=f"t{tmp_path.name}").collect()}
        assert got[10] == (10, False) and got[12] == (10, True) and got[11] == (11, False) and got[13] == (13, False)
    assert got[1] == (10, True) and got[2] == (2, False) and got[3] == (2, True) and got[4] == (4, False) and len(got) == 8


def test_batches_do_not_change_the_result(spark, table):
    rows = corpus()
    path = table(rows[::-1], files=5)
    one, many = (sorted((tuple(r) for r in exact.dedup(spark, path, files_per_batch=k).collect()), key=str) for k in (99, 1))
    assert one == many
