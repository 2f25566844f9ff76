"""The graph in factors: against the joins of ``resolve``, in one part and in several, and what the queries move."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.operators import evidence, factored, graph, index, resolve
from siltstone.operators.resolve import _KEY
from siltstone.plans import index_queries
from siltstone.session import materialize

from .test_graph import f, make

HOT = 300


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A folder with a repository whose every file defines and asks for the same two names."""
    folder = tmp_path_factory.mktemp("hot")
    rows = [f(f"d{i % 7}/{'test_' if i % 50 == 0 else ''}m{i}.py", "python", [("get", "function"), ("run", "function"), (f"own{i}", "class")], [("get", "calls"), ("run", "calls"), (f"own{(i + 1) % HOT}", "calls")]) for i in range(HOT)]
    files = make(spark, *rows).withColumn("run_id", F.lit(1).cast("bigint")).withColumn("indexed_at", F.lit("2025-01-01").cast("timestamp"))
    files.coalesce(2).write.parquet(f"{folder}/files.parquet")
    return str(folder)


def moved(spark, run) -> int:
    """Bytes that ``run`` shuffles and writes to the shared folder."""
    tracker, none = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages() -> list:
        tracker.listenerBus().waitUntilEmpty()
        found = tracker.statusStore().stageList(None, False, False, none, None)
        return [found.apply(k) for k in range(found.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    run()
    return sum(s.shuffleWriteBytes() + s.outputBytes() for s in stages() if s.stageId() > last)


def by_joins(files):
    """All edges by joins of asks with targets."""
    refs, symbols = index.references_of(files).withColumn("kind", F.lower(F.trim("kind"))), index.symbols_of(files)
    found = resolve.targets(materialize(resolve.resolve(files, refs, symbols), "resolved"), files, symbols).withColumnsRenamed({c: f"_{c}" for c in _KEY})
    same = [F.col(c) == F.col(f"_{c}") for c in _KEY]
    asked = refs.filter("target_file is null").join(found, same[0] & same[1] & same[2] & same[3]).withColumn("dst", F.col("target"))
    given = refs.filter("target_file is not null").withColumn("dst", F.col("target_file"))
    links = [d.select("repo", F.col("path").alias("src"), "dst", "kind", F.col("target_name").alias("symbol"), "ord") for d in (asked, given)]
    tests = graph.test_edges(files).select("repo", "src", "dst", F.lit("tests").alias("kind"), F.concat(F.lit("test:"), "stem").alias("symbol"), F.lit(0).alias("ord"))
    return graph.edges_of(links[0].unionByName(links[1]).unionByName(tests))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


EDGE = ("repo", "src", "dst", "kind", "symbols")


@pytest.mark.parametrize("part_refs", [10**6, 40])
def test_edges_as_by_joins(spark, small, part_refs):
    table = spark.read.parquet(f"{small}/files.parquet")
    assert rows(factored.edges(factored.parts_of(table, part_refs=part_refs)), *EDGE) == rows(by_joins(materialize(index.current_files(table), "files")), *EDGE)


def test_odd_references(spark):
    odd = [
        f("a/b.py", "python", [("dup", "function"), ("dup", "function"), (None, "class")], [("dup", "calls"), ("x", "calls", "a/b.py"), ("x", "calls", "gone.py"), ("x", " Calls "), (None, "calls", "p/x.py"), (None, "calls"), ("", "calls"), ("..", "imports")]),
        f("p/x.py", "python", [("x", "function"), ("dup", "function")], [("dup", None), ("x", "tests")]), f("q/x.py", "python", [("x", "function")]), f("q/test_x.py", "python", [], [("test:x", "tests", "q/x.py")]),
        f("/r/X.java", "java", [("X", "class")], [(".*", "imports"), ("r.X", "imports"), ("X", "calls")]), f("r\\s/y.rs", "rust", [("T", "class")], [("crate::T", "imports"), ("super::", "imports"), ("a:::T", "calls")]),
        f("top.go", "go", [], [(".", "imports"), ("q", "imports")]), f("q/k.go", "go"), f("i/index.ts", "typescript", [], [("/p/../i", "imports"), ("./.././i", "imports")]), f("A.x", "binary"),
    ]
    files = make(spark, *[(*r[:5], r[5] or None, r[6] or None) for r in odd])
    want = rows(by_joins(files), *EDGE)
    assert len(want) > 8
    for part_refs in (10**6, 2):
        assert rows(factored.edges(factored.parts_of(files, part_refs=part_refs)), *EDGE) == want


def test_latest_row_counts_in_every_part(spark):
    files = make(spark, f("a.py", "python", [("old", "function")], [("b", "imports")]), f("a.py", "python", [("new", "function")], [("c", "imports")]), f("b.py", "python"), f("c.py", "python", [], [("a", "imports")]))
    files = files.withColumn("run_id", F.when(F.array_contains("symbols.name", "new"), 2).otherwise(1).cast("bigint")).withColumn("indexed_at", F.lit(None).cast("timestamp"))
    for part_refs in (10**6, 1):
        assert rows(factored.edges(factored.parts_of(files, part_refs=part_refs)), "src", "dst") == [("a.py", "c.py"), ("c.py", "a.py")]


@pytest.mark.parametrize("folder", ["small", "hot"])
def test_several_parts_rank_as_one(spark, request, folder):
    table = spark.read.parquet(f"{request.getfixturevalue(folder)}/files.parquet")
    value = F.expr(f"if({t.is_test_path('path')}, 2.0D, 0.0D)")
    one, many = (factored.parts_of(table, value, part_refs=n, loop=n < 100) for n in (10**6, 60))
    assert many.filter("part > 0").count() > 0 and one.filter("loop").isEmpty()
    a, b = ({(r.repo, r.path): r for r in factored.scores(p, folder == "hot", near=True).collect()} for p in (one, many))
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert all(abs(r[c] - b[k][c]) < 1e-12 for c in ("value", "top_value", "near", "top_near", "score", "top_score")) and r.known == b[k].known
    near = ("repo", "path", "k", "other", "direction", "kind", "symbols")
    want = rows(evidence.evidence_neighbors(factored.edges(one)), *near)
    assert want and rows(factored.neighbors(one), *near) == rows(factored.neighbors(many), *near) == want
    some = spark.createDataFrame({(r[0], r[1]) for r in want[::9]}, "repo string, path string")
    assert rows(factored.neighbors(one, only=some), *near) == rows(factored.neighbors(many, only=some), *near) == [r for r in want if (r[0], r[1]) in {tuple(x) for x in some.collect()}]
    weights = graph.weights_of(factored.edges(one))
    assert [(*r[:3], round(r[3], 9)) for r in rows(factored.weights(many), "repo", "src", "dst", "weight")] == [(*r[:3], round(r[3], 9)) for r in rows(weights, "repo", "src", "dst", "weight")]


#: Queries over the graph. In the hot repository 90,000 edges stand in 100 kB of files.
OVER_THE_GRAPH = ("edge_merge", "evidence_neighbors", "pagerank_distributed", "pagerank_global", "evidence_query", "evidence_query_files", "evidence_files", "evidence_seed_files", "rank_test_query", "rank_query", "weighted_digraph", "rendered_whole", "rendered_maps", "rendered_json", "tiers_summary", "seed_expansion", "rank_files", "pagerank_personalized")


@pytest.mark.parametrize("name", OVER_THE_GRAPH)
def test_edges_do_not_move(spark, hot, name):
    made = moved(spark, lambda: index_queries.QUERIES[name](spark, hot).write.format("noop").mode("overwrite").save())
    assert 0 < made < 1_000_000
