"""Bitmaps of terms against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm.terms import DENSE, cardinality, marked, pack, remaining_records, term_bitmaps, term_frequencies, union, unpack

SCHEMA = "id bigint, record bigint, kind string, name string, ids string"


@pytest.mark.parametrize("n", [0, 1, 10, DENSE - 1, DENSE, 30_000, 65_536])
def test_containers(n):
    v = np.sort(np.random.default_rng(n).choice(65_536, n, replace=False)).astype(np.uint16)
    c = pack(v)
    assert (unpack(c) == v).all() and cardinality(c) == n and len(c) <= 8192


def test_union():
    rng = np.random.default_rng(0)
    for sizes in ((5, 9), (5000, 3), (4000, 4000), (6000, 7000, 10)):
        sets = [np.sort(rng.choice(65_536, n, replace=False)).astype(np.uint16) for n in sizes]
        assert set(unpack(union([pack(s) for s in sets]))) == set().union(*map(set, sets))


def frequencies(spark, rows, chunk=500_000):
    got = term_frequencies(term_bitmaps(spark.createDataFrame(rows, SCHEMA), chunk)).collect()
    return {(r.kind, r.name): (r.occurrences, r.n_files) for r in got}


def test_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(9000):
        kind = rnd.choice(["function", "class", None])
        name = "hot" if rnd.random() < 0.4 else rnd.choice([None, "", f"n{rnd.randint(0, 200)}", "ünï"])
        rows.append((rnd.choice([i, i, i, None]), rnd.choice([None, rnd.randint(0, 200_000), rnd.randint(-5, 50)]), kind, name, "x"))
    rows += rnd.sample([r for r in rows if r[0] is not None], 2000)
    want = defaultdict(lambda: [0, set()])
    seen = set()
    for i, f, k, n, _ in rows:
        if k is None or n is None or (i is not None and i in seen):
            continue
        seen.add(i)
        want[k, n][0] += 1
        want[k, n][1] |= {f} - {None}
    want = {k: (a, len(b)) for k, (a, b) in want.items()}
    assert frequencies(spark, rows) == want
    assert frequencies(spark, rows, chunk=700) == want  # containers of many parts
    held = {f for i, f, k, n, _ in rows if k is not None and n is not None and f is not None}
    assert remaining_records(term_bitmaps(spark.createDataFrame(rows, SCHEMA))).first().n == len(held)


def test_dense(spark):
    rows = [(i, i, "k", "n", "x") for i in range(70_000)]
    assert frequencies(spark, rows) == {("k", "n"): (70_000, 70_000)}


def test_a_term_in_all_records_fills_several_tasks(spark):
    rows = spark.range(40 << 16).selectExpr("id", "id AS record", "'k' AS kind", "'n' AS name")
    b = term_bitmaps(rows)
    tasks = {r[0] for r in b.selectExpr("spark_partition_id()", "bucket").distinct().collect()}
    assert len(tasks) > 1 and b.count() == 40
    assert [tuple(r) for r in term_frequencies(b).collect()] == [("k", "n", 40 << 16, 40 << 16)]
    assert remaining_records(b).first().n == 40 << 16


def test_empty_and_marks(spark):
    assert frequencies(spark, []) == {}
    assert remaining_records(term_bitmaps(spark.createDataFrame([], SCHEMA))).first().n == 0
    f = spark.createDataFrame([("k", "one", 3, 1), ("k", "some", 3, 2), ("k", "many", 9, 5)], "kind string, name string, occurrences bigint, n_files bigint")
    assert {r.name: r.mark for r in marked(f, 100).collect()} == {"one": "rare", "some": None, "many": "common"}


def test_against_sql(spark, small, sql):
    from siltstone.llm.queries import QUERIES, SQL

    from ..helpers import same_as_sql

    for name in ("p5_found", "p5_term_frequencies"):
        same_as_sql(QUERIES[name](spark, small), sql, SQL[name])
