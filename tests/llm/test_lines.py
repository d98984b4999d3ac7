import random

from quern.llm import lines
from tests.llm.conftest import EDGES, LONG


def brute(rows):
    """rows in the order of first: (doc_id with null last, place)."""
    seen, out = set(), {}
    for k in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        t = rows[k][1]
        if t is None:
            out[k] = (None, 0, 0)
            continue
        all_, left = t.split("\n"), []
        for x in all_:
            if not x.strip(" \t\r") or x not in seen:
                left.append(x)
            seen.add(x)
        out[k] = ("\n".join(left), len(all_), len(all_) - len(left))
    return sorted(((rows[k][0], *v) for k, v in out.items()), key=str)


def run(spark, path, **kw):
    return sorted((tuple(r) for r in lines.dedup_lines(spark.read.parquet(path), **kw).collect()), key=str)


def test_against_brute_force_whatever_the_batches(spark, table):
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice(["", "  ", "\t"] + [f"line {k}" for k in range(40)]) for _ in range(r.randint(1, 8)))) for i in range(120)]
    r.shuffle(rows)
    path = table(rows)
    want = brute(rows)
    for kw in ({"batches": 1}, {"batches": 7, "fanout": 2}, {"batches": 5, "fanout": 3}):
        assert run(spark, path, **kw) == want


def test_levels(spark):
    runs = lines.Runs(spark, 2)
    try:
        for k in range(7):
            runs.add(spark.createDataFrame([(h, 0, False, k, k, 0) for h in range(k, k + 3)], "h1 bigint, h2 bigint, id_null boolean, doc_id bigint, row bigint, line int"))
        assert [len(x) for x in runs.levels] == [1, 1, 1]
        assert sorted((r["h1"], r["doc_id"]) for r in runs.all().collect()) == [(0, 0), (1, 0), (2, 0)] + [(k + 2, k) for k in range(1, 7)]
        plan = spark.table(runs.names()[0]).select("h1", "h2").hint("merge").join(spark.table(runs.names()[1]).select("h1", "h2"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        runs.close()


def test_edges(spark, table):
    got = run(spark, table(EDGES, files=1))
    assert got == brute(EDGES)
    assert (4, LONG, 1, 0) in got
    assert run(spark, table([])) == []


def test_second_delivery_meets_the_first(spark, table, tmp_path):
    """Named runs outlive the call, and the session's tables."""
    name = f"t{tmp_path.name}".replace("-", "_")
    one, two = table([(5, "a\nb"), (6, "b\nc")]), table([(1, "c\nd"), (2, "d\na\ne"), (3, None)])
    assert run(spark, one, state=name) == [(5, "a\nb", 2, 0), (6, "c", 2, 1)]
    assert run(spark, two, state=name) == [(1, "d", 2, 1), (2, "e", 3, 2), (3, None, 0, 0)]
    assert run(spark, two, state=name) == [(1, "", 2, 2), (2, "", 3, 3), (3, None, 0, 0)]
    lines.Runs(spark, name=name).close()
