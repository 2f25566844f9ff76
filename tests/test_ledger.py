"""Interval arithmetic, and runs that fail at any point without skipping or repeating records."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.streaming.ledger import BLOCK, IntervalLedger, ledger_runs, merge_spans, pending_scans, rows_in, scan_verdicts, spans, spans_of, subtract, subtract_spans, union

NUMBERS = st.sets(st.integers(0, 60))


def runs(s):
    v = np.array(sorted(s), np.int64)
    return merge_spans(v, v + 1)


def members(lo, hi):
    return {n for a, b in zip(lo, hi) for n in range(a, b)}


@settings(max_examples=200, deadline=None)
@given(NUMBERS, NUMBERS)
def test_arithmetic(a, b):
    (alo, ahi), (blo, bhi) = runs(a), runs(b)
    lo, hi = subtract_spans(alo, ahi, blo, bhi)
    assert members(lo, hi) == a - b and (hi[:-1] < lo[1:]).all()
    lo, hi = merge_spans(np.r_[alo, blo], np.r_[ahi, bhi])
    assert members(lo, hi) == a | b and (hi[:-1] < lo[1:]).all()


def numbers(spark, v):
    return spark.createDataFrame([(x,) for x in v], "n bigint")


def test_blocks(spark):
    have = [1, 2, 3, 7, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK, None, 3]
    a = spans_of(numbers(spark, have), "n")
    assert sorted(map(tuple, spans(a).collect())) == [(1, 4), (7, 8), (BLOCK - 1, BLOCK), (BLOCK, BLOCK + 2), (5 * BLOCK, 5 * BLOCK + 1)]
    b = spans_of(numbers(spark, [2, 7, BLOCK, 9 * BLOCK]), "n")
    left = rows_in(numbers(spark, have), "n", subtract(a, b))
    assert sorted(r.n for r in left.collect()) == [1, 3, 3, BLOCK - 1, BLOCK + 1, 5 * BLOCK]
    assert sorted(map(tuple, spans(union(a, b)).collect()))[-1] == (9 * BLOCK, 9 * BLOCK + 1)
    assert spans_of(numbers(spark, []), "n").count() == 0


def test_runs_survive_failures(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger")
    done = lambda: sorted(r.n for p in ledger.outputs() for r in spark.read.parquet(p).collect())
    assert ledger.run(numbers(spark, [1, 2, 5]), "n", lambda d: d) == 1
    assert done() == [1, 2, 5]

    def fail(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(numbers(spark, [1, 2, 3, 5, 9]), "n", fail)
    boom = spark.udf.register("boom", lambda x: 1 // 0, "int")
    with pytest.raises(Exception):  # fails while the output is being written
        ledger.run(numbers(spark, [1, 2, 3, 5, 9]), "n", lambda d: d.select(boom("n").alias("n")))
    assert done() == [1, 2, 5]
    late = numbers(spark, [1, 2, 3, 4, 5, 9])  # 3 and 4 come late, into an old gap
    assert ledger.run(late, "n", lambda d: d) == 2
    assert done() == [1, 2, 3, 4, 5, 9]
    assert ledger.run(late, "n", lambda d: d) == 2  # nothing to do
    assert sorted(map(tuple, spans(ledger.processed()).collect())) == [(1, 6), (9, 10)]


def test_two_runs_at_once(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger")

    def other_commits_first(d):
        IntervalLedger(spark, ledger.root).run(numbers(spark, [1]), "n", lambda x: x)
        return d

    with pytest.raises(RuntimeError, match="another run"):
        ledger.run(numbers(spark, [1, 2]), "n", other_commits_first)
    assert len(ledger.outputs()) == 1


def test_a_failure_before_the_commit(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger")

    def lose():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        ledger.run(numbers(spark, [1, 2, None]), "n", lambda d: d, before_commit=lose)
    assert ledger.outputs() == [] and ledger.read_outputs("n bigint").count() == 0
    assert ledger.run(numbers(spark, [1, 2, 3, None]), "n", lambda d: d) == 1
    assert sorted(r.n for r in ledger.read_outputs("n bigint").collect()) == [1, 2, 3]
    assert not [p for p in (tmp_path / "ledger").iterdir() if p.name.startswith(".staged")]


def test_runs_over_scans(spark, small, sql, tmp_path):
    from siltstone.plans.core_queries import QUERIES, SQL

    from .helpers import same_as_sql

    same_as_sql(QUERIES["p4_method"](spark, small), sql, SQL["p4_method"])
    done = QUERIES["p4_method"](spark, small)
    due = {tuple(r) for r in done.filter("pending").select("scan_id", "repo", "path").collect()}
    assert due == {tuple(r) for r in QUERIES["p4_pending_scans"](spark, small).collect()}
    assert done.count() == done.select("scan_id").distinct().count()
    scans = spark.read.parquet(f"{small}/file_scans.parquet").limit(0)
    files, runs_ = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("files", "index_runs"))
    assert ledger_runs(scans, files, runs_, f"file://{tmp_path}/none").count() == 0


def test_pending(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    scans = spark.createDataFrame(
        [
            (1, "r", "a.py", "H1", False, t(1)), (2, "r", "./a.py", "H2", False, t(3)), (2, "r", "./a.py", "H2", False, t(3)),  # changed
            (3, "r", "b.py", "h1", False, t(1)),  # same content, other case
            (4, "r", "c.py", "h9", False, t(1)),  # indexed later
            (5, "r", "d.py", None, True, t(5)), (6, "r", "d.py", "h1", False, t(1)),  # deleted
            (7, "r", "x\\y/../e.py", "h1", False, t(1)),  # never indexed
            (8, "r", "f.py", "h1", False, t(1)),  # only a failed run
            (9, "r", "g.py", "h2", False, t(4)), (10, "r", "g.py", "h1", False, t(4)),  # a tie in time: the greater id counts
            (None, "r", "n.py", "h", False, t(1)), (11, None, "n.py", "h", False, t(1)), (12, "r", None, "h", False, t(1)),
        ],
        "scan_id bigint, repo string, path string, content_hash string, is_deleted boolean, seen_at timestamp",
    )
    files = spark.createDataFrame(
        [("r", "a.py", "h1", 1, t(2)), ("r", "b.py", "H1", 1, t(0)), ("r", "c.py", "h1", 1, t(2)), ("r", "d.py", "h1", 1, t(2)), ("r", "f.py", "h1", 2, t(2)), ("r", "g.py", "h1", 1, t(1)), ("r", "z.py", "h1", 1, t(1))],
        "repo string, path string, content_hash string, run_id bigint, indexed_at timestamp",
    )
    runs_ = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, None)], "run_id bigint, status string")
    got = pending_scans(scans, files, runs_)
    assert sorted((r.scan_id, r.path) for r in got.collect()) == [(2, "a.py"), (7, "x/e.py"), (8, "f.py")]
    assert pending_scans(scans.limit(0), files, runs_).count() == 0
    assert pending_scans(scans, files.limit(0), runs_).count() == 6


def test_no_history_is_gathered(spark):
    scans = spark.createDataFrame([(1, "r", "a.py", "h1", False, dt.datetime(2025, 1, 1))], "scan_id bigint, repo string, path string, content_hash string, is_deleted boolean, seen_at timestamp")
    files = spark.createDataFrame([], "repo string, path string, content_hash string, run_id bigint, indexed_at timestamp")
    plan = scan_verdicts(scans, files, spark.createDataFrame([], "run_id bigint, status string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
