"""Dense per-key totals against brute force, skewed and dirty."""

import random
from collections import defaultdict

from siltstone.operators.keyagg import heavy_keys, key_totals

SCHEMA = "side string, id bigint, name string, file_id bigint, target string"


def brute(rows):
    seen, once = {}, []
    for r in rows:
        if r[2] is None:
            continue
        c = (r[2].strip(" \t"), r[3], r[4])
        if r[1] is None:
            once.append((r[0], c))
        else:
            k = (r[0], r[1])
            low = lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "")
            if k not in seen or low(c) < low(seen[k]):
                seen[k] = c
    once += [(k[0], c) for k, c in seen.items()]
    out = defaultdict(lambda: [0, set(), 0, set()])
    for side, (name, f, t) in once:
        o = out[side, name]
        o[0] += 1
        o[1] |= {f} - {None}
        o[2] += t is not None
        o[3] |= {t} - {None}
    return {k: (v[0], len(v[1]), v[2], len(v[3])) for k, v in out.items()}


def totals(spark, rows, **kw):
    df = key_totals(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_rows", "2 as block"), **kw)
    return {(r.side, r.name): (r.n_rows, r.n_files, r.n_resolved, r.n_targets) for r in df.collect()}


def test_skew_and_dirt(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        name = "hot" if rnd.random() < 0.4 else rnd.choice([None, "", " a", "a\t", f"n{rnd.randint(0, 300)}", "ü" * rnd.randint(1, 9)])
        rows.append((rnd.choice(["symbol", "reference"]), rnd.choice([None, i, i, i]), name, rnd.choice([None, rnd.randint(1, 40)]), rnd.choice([None, None, f"t{rnd.randint(0, 9)}"])))
    rows += rnd.sample(rows, 1500)
    assert totals(spark, rows) == brute(rows)
    assert totals(spark, rows, chunk=1000) == brute(rows)  # arrays are flushed and summed again
    assert totals(spark, rows, block_names=5) == brute(rows)  # more blocks than splits


def test_conflicting_rows_of_one_id(spark):
    rows = [("symbol", 1, "b", 1, None), ("symbol", 1, "a", 2, None)]
    assert totals(spark, rows) == {("symbol", "a"): (1, 1, 0, 0)}


def test_empty(spark):
    assert totals(spark, []) == {}


def test_share_at_the_bound(spark):
    rows = [("symbol", i, "x" if i < 2 else f"y{i}", 1, None) for i in range(100)]
    got = heavy_keys(key_totals(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.side, r.key_name, r.n_rows, r.side_rows) for r in got] == [("symbol", "x", 2, 100)]


def test_no_set_of_a_hot_name_is_gathered(spark):
    df = key_totals(spark.createDataFrame([("symbol", 1, "a", None, "t")], SCHEMA))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
