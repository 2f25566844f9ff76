"""Resolution, edges, ranks and evidence on small hand-made repositories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import evidence, graph, index, lexical, pagerank, rank, resolve

SYM = index.SYMBOL
SCHEMA = f"repo string, path string, language string, content_hash string, lines int, symbols array<{SYM}>, refs array<{index.REFERENCE}>"


def f(path, language, symbols=(), refs=(), repo="r"):
    s = [(n, k, path, i + 1, f"sig {n}", None, None, i) for i, (n, k) in enumerate(symbols)]
    r = [(path, n, target, i + 1, kind, i) for i, (n, kind, target) in enumerate((*x, None)[:3] for x in refs)]
    return (repo, path, language, "h", 1, s, r)


def make(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def links(spark, *rows):
    files = make(spark, *rows)
    return {(e.src, e.dst, e.kind) for e in graph.build(files).collect()}


PYTHON = (
    f("pkg/models.py", "python", [("User", "class"), ("Admin", "class")], [("User", "inherits")]),
    f("pkg/auth.py", "python", [("login", "function")], [(".models", "imports")]),
    f("pkg/app.py", "python", [("run", "function")], [("pkg.auth", "imports"), ("models", "imports"), ("os.path", "imports"), ("User", "uses_type")]),
    f("tests/test_auth.py", "python", [], [("pkg.auth", "imports")]),
)


def test_python(spark):
    assert links(spark, *PYTHON) == {
        ("pkg/auth.py", "pkg/models.py", "imports"), ("pkg/app.py", "pkg/auth.py", "imports"), ("pkg/app.py", "pkg/models.py", "imports"), ("pkg/app.py", "pkg/models.py", "uses_type"),
        ("tests/test_auth.py", "pkg/auth.py", "imports"), ("tests/test_auth.py", "pkg/auth.py", "tests"),
    }


def test_python_relative(spark):
    got = links(spark, f("a/b/c.py", "python", [], [("..x", "imports"), (".", "imports"), ("...y.z", "imports"), ("....q", "imports")]), f("a/x.py", "python"), f("a/b/__init__.py", "python"), f("y/z.py", "python"), f("q.py", "python"))
    assert got == {("a/b/c.py", "a/x.py", "imports"), ("a/b/c.py", "a/b/__init__.py", "imports"), ("a/b/c.py", "y/z.py", "imports"), ("a/b/c.py", "q.py", "imports")}


def test_typescript(spark):
    got = links(
        spark, f("src/a.ts", "typescript", [], [("./b", "imports"), ("../lib", "imports"), ("react", "imports"), ("Base", "inherits")]), f("src/b.tsx", "typescript", [("Base", "class")]), f("lib/index.ts", "typescript"),
        f("src/__tests__/a.test.ts", "typescript", [], [("../a", "imports")]),
    )
    assert got == {("src/a.ts", "src/b.tsx", "imports"), ("src/a.ts", "lib/index.ts", "imports"), ("src/__tests__/a.test.ts", "src/a.ts", "imports"), ("src/__tests__/a.test.ts", "src/a.ts", "tests")}


def test_go(spark):
    got = links(spark, f("cmd/main.go", "go", [], [("pkg/util", "imports"), ("fmt", "imports")]), f("pkg/util/a.go", "go"), f("pkg/util/b.go", "go"), f("x/pkg/util/c.go", "go"))
    assert got == {("cmd/main.go", "pkg/util/a.go", "imports"), ("cmd/main.go", "pkg/util/b.go", "imports")}
    got = links(spark, f("cmd/main.go", "go", [], [("util", "imports")]), f("pkg/util/a.go", "go"), f("x/util/c.go", "go"), f("myutil/d.go", "go"))
    assert got == {("cmd/main.go", "pkg/util/a.go", "imports"), ("cmd/main.go", "x/util/c.go", "imports")}


def test_rust(spark):
    got = links(
        spark, f("src/a/b.rs", "rust", [], [("crate::net::Conn", "imports"), ("super::util::x", "imports"), ("std::Thing", "imports")]), f("src/net/mod.rs", "rust"), f("src/util.rs", "rust"), f("src/z.rs", "rust", [("Thing", "class")])
    )
    assert got == {("src/a/b.rs", "src/net/mod.rs", "imports"), ("src/a/b.rs", "src/util.rs", "imports"), ("src/a/b.rs", "src/z.rs", "imports")}


def test_java(spark):
    got = links(
        spark, f("src/Main.java", "java", [("Main", "class")], [("com.example.ServiceA", "imports"), ("com.example.*", "imports"), ("Main", "inherits")]),
        f("lib/com/other/ServiceA.java", "java"), f("lib/com/example/ServiceA.java", "java"), f("com/example/sub/X.java", "java"),
    )
    assert got == {("src/Main.java", "lib/com/example/ServiceA.java", "imports"), ("src/Main.java", "com/example/sub/X.java", "imports")}


def test_collisions(spark):
    files = make(
        spark, f("p1/a.x", "other", [], [("Helper", "calls"), ("Config", "calls"), ("Twice", "calls"), ("Top", "calls"), ("Mine", "calls")]), f("p2/h.x", "other", [("Helper", "class")]), f("p3/h.x", "other", [("Helper", "class")]),
        f("p1/c.x", "other", [("Config", "class")]), f("p4/c.x", "other", [("Config", "class")]), f("p5/t.x", "other", [("Twice", "class"), ("Twice", "class")]), f("p1/q/t.x", "other", [("Top", "class")]), f("p6/t.x", "other", [("Top", "class")]),
        f("p1/a.y", "other", [("Mine", "class")]),
    )
    refs, symbols = index.references_of(files), index.symbols_of(files)
    got = {r.target_name: (r.how, r.n_targets, r.target) for r in resolve.resolve(files, refs, symbols).collect()}
    assert got == {
        "Helper": ("ambiguous", 2, None), "Config": ("symbol", 1, "p1/c.x"), "Twice": ("ambiguous", 2, None), "Top": ("symbol", 1, "p1/q/t.x"), "Mine": ("symbol", 1, "p1/a.y"),
    }
    assert {(e.src, e.dst) for e in graph.build(files).collect()} == {("p1/a.x", p) for p in ("p2/h.x", "p3/h.x", "p1/c.x", "p5/t.x", "p1/q/t.x", "p1/a.y")}


def test_repositories_are_apart_and_given_targets_pass(spark):
    got = links(spark, f("a.py", "python", [], [("b", "imports"), ("ext", "imports", "gone/x.py")]), f("b.py", "python", repo="other"))
    assert got == {("a.py", "gone/x.py", "imports")}


def test_nearest_source_of_a_test(spark):
    got = links(spark, f("a/tests/test_x.py", "python"), f("a/x.py", "python"), f("b/c/x.py", "python"), f("T/FooTest.java", "java"), f("S/Foo.java", "java"), f("g/y_test.go", "go"), f("g/y.go", "go"))
    assert got == {("a/tests/test_x.py", "a/x.py", "tests"), ("T/FooTest.java", "S/Foo.java", "tests"), ("g/y_test.go", "g/y.go", "tests")}


def edges(spark, *e, repo="r"):
    return spark.createDataFrame([(repo, a, b, k, ["s"]) for a, b, k in e], "repo string, src string, dst string, kind string, symbols array<string>")


CHAIN = [("a", "b", "imports"), ("b", "c", "imports")]


def dense(edge_list, n, p=None, steps=100, tol=1e-6):
    """PageRank written plainly."""
    p = np.full(n, 1 / n) if p is None else p
    m = np.zeros((n, n))
    for a, b, w in edge_list:
        m[b, a] += w
    out = m.sum(0)
    x = p.copy()
    for _ in range(steps):
        y = 0.15 * p + 0.85 * (m[:, out > 0] / out[out > 0]) @ x[out > 0] + 0.85 * x[out == 0].sum() * p
        stop = np.abs(y - x).sum() < n * tol
        x = y
        if stop:
            break
    return x / x.sum()


@pytest.mark.parametrize("bound", [10**6, 0])  # the kernel, and the distributed loop
def test_pagerank(spark, bound):
    rng = np.random.default_rng(1)
    arcs = {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != b}
    e = spark.createDataFrame([("r", f"n{a}", f"n{b}", 1.0 + a % 3) for a, b in arcs] + [("q", "x", "y", 1.0)], "repo string, src string, dst string, weight double")
    nodes = spark.createDataFrame([("r", f"n{i}") for i in range(12)] + [("q", "x"), ("q", "y"), ("one", "z")], "repo string, path string")
    tol = 1e-9 if bound else 1e-3
    got = {(r.repo, r.path): r.score for r in pagerank.pagerank(nodes, e, kernel_edges=bound, tolerance=tol).collect()}
    want = dense([(a, b, 1.0 + a % 3) for a, b in arcs], 12, tol=tol)
    assert np.allclose([got["r", f"n{i}"] for i in range(12)], want, atol=1e-9)
    assert got["one", "z"] == pytest.approx(1.0) and got["q", "y"] > got["q", "x"]


def test_pagerank_personal(spark):
    nodes = spark.createDataFrame([("r", c) for c in "abc"], "repo string, path string")
    w = graph.weights_of(edges(spark, *CHAIN))
    personal = spark.createDataFrame([("r", "a", 2.0), ("r", "b", -1.0)], "repo string, path string, w double")
    got = {r.path: r.score for r in pagerank.pagerank(nodes, w, personal).collect()}
    assert np.allclose([got[c] for c in "abc"], dense([(0, 1, 1), (1, 2, 1)], 3, np.array([1.0, 0, 0])), atol=1e-9)
    none = personal.withColumn("w", F.lit(0.0))
    assert {r.path: r.score for r in pagerank.pagerank(nodes, w, none).collect()} == {r.path: r.score for r in pagerank.pagerank(nodes, w).collect()}
    assert pagerank.pagerank(nodes.limit(0), w.limit(0)).count() == 0


def test_weights_add_up(spark):
    got = {(r.src, r.dst): r.weight for r in graph.weights_of(edges(spark, ("a", "b", "imports"), ("a", "b", "tests"), ("a", "b", "odd"), ("a", "c", "calls"))).collect()}
    assert got == {("a", "b"): 3.25, ("a", "c"): 0.9}


def test_edges_merge_in_order(spark):
    rows = [("r", "a", "b", "imports", "z", 1), ("r", "a", "b", "imports", "y", 2), ("r", "a", "b", "imports", "z", 3), ("r", "a", "a", "imports", "self", 0)]
    got = graph.edges_of(spark.createDataFrame(rows, "repo string, src string, dst string, kind string, symbol string, ord int")).collect()
    assert [(r.src, r.dst, r.symbols) for r in got] == [("a", "b", ["z", "y"])]


def test_expansion(spark):
    seeds = spark.createDataFrame([("r", "a", 1.0), ("r", "d", 0.0)], "repo string, path string, score double")
    near = graph.neighbors(edges(spark, *CHAIN, ("c", "d", "imports")))
    assert {r.path: round(r.score, 6) for r in rank.expand(seeds, near).collect()} == {"a": 1.0, "b": 0.6, "c": 0.36, "d": 0.0}


def order(df):
    return [r.path for r in rank.ranked(df).orderBy("rank").collect()]


def test_files_first_then_near(spark):
    files = make(spark, f("a", "python"), f("b", "python"), f("c", "python"))
    seeds = spark.createDataFrame([("r", "a")], "repo string, path string")
    assert order(rank.rank_for_files(files, edges(spark, *CHAIN), seeds)) == ["a", "b", "c"]


def test_words_beat_structure_and_sources_beat_tests(spark):
    files = make(
        spark, f("core/base.py", "python", [("Base", "class")]), f("run/daemon_executor.py", "python", [("DaemonExecutor", "class")]), f("x/tests/test_daemon_executor.py", "python", [("daemon_executor", "function")]),
        *[f(f"m{i}.py", "python") for i in range(4)],
    )
    e = edges(spark, *[(f"m{i}.py", "core/base.py", "imports") for i in range(4)], ("x/tests/test_daemon_executor.py", "run/daemon_executor.py", "tests"))
    got = order(rank.rank_for_query(files, e, "daemon executor"))
    assert got[0] == "run/daemon_executor.py" and got.index("x/tests/test_daemon_executor.py") < got.index("core/base.py")
    plain = order(rank.rank_for_query(files, e, "nothing matches"))
    assert plain[0] == "core/base.py"


def test_lexical_cases(spark):
    files = make(spark, f("a/user_service.py", "python", [("UserService", "class")]), f("b.py", "python", []), f("user service.py", "python", []))
    score = lambda q: {r.path: r.lexical for r in lexical.lexical(files, q).collect()}
    one = score("user")
    # a symbol's token 7, above the path's token 4 and the base name's part 5; plus 1.5 for the match
    assert one == {"a/user_service.py": 8.5, "b.py": 0.0, "user service.py": 6.5}
    both = score("user service")
    # stem shape 28 + order 14 + variant 26, the symbol's shape 22 for each word, 2 x 1.5, all words 6
    assert both["a/user_service.py"] == 28 + 14 + 26 + 44 + 3 + 6
    assert both["user service.py"] == 28 + 24 + 26 + 10 + 3 + 6
    assert score("") == {"a/user_service.py": 0.0, "b.py": 0.0, "user service.py": 0.0}
    assert score("User USER")["b.py"] == 0.0


def test_tiers(spark):
    df = spark.createDataFrame([("r", f"p{i:02}", float(-i)) for i in range(10)] + [("q", "x", 1.0)], "repo string, path string, score double")
    got = {(r.repo, r.path): r.tier for r in rank.tiers(df).collect()}
    assert [got["r", f"p{i:02}"] for i in range(10)] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4] and got["q", "x"] == 1


def test_evidence(spark):
    files = make(spark, *PYTHON)
    e = graph.build(files)
    pack = evidence.query_evidence(files, e, "login auth").first()
    top = pack.files[0]
    assert top.path == "pkg/auth.py" and "symbol-match" in top.reasons and "path-match" in top.reasons and "full-path-keyword-cover" not in top.reasons
    assert [s.name for s in top.symbols] == ["login"] and top.focus_range.asDict() == {"start": 1, "end": 1}
    assert {(n.path, n.kind, n.direction) for n in top.neighbors} <= {("pkg/models.py", "imports", "outgoing"), ("pkg/app.py", "imports", "incoming"), ("tests/test_auth.py", "imports", "incoming"), ("tests/test_auth.py", "tests", "incoming")}
    assert 0 < pack.confidence <= 1 and pack.matched_terms == ["auth", "login"] and pack.missed_terms == []
    assert len(evidence.query_evidence(files, e, "login", limit=0).first().files) == 1
    assert evidence.query_evidence(files, e, "...").count() == 0
    seeds = spark.createDataFrame([("r", "pkg/auth.py"), ("r", "no.py")], "repo string, path string")
    pack = evidence.file_evidence(files, e, seeds).first()
    assert pack.seed_files == ["pkg/auth.py"] and pack.files[0].reasons[0] == "seed-file" and pack.confidence >= 0.9


def test_method_beats_function_on_a_line(spark):
    rows = [("r", "p", "f", "function", 1), ("r", "p", "f", "method", 1), ("r", "p", "g", "function", 2), ("r", "q", "f", "function", 1)]
    got = index.drop_functions_of_methods(spark.createDataFrame(rows, "repo string, path string, name string, kind string, line int")).collect()
    assert sorted((r.path, r.name, r.kind) for r in got) == [("p", "f", "method"), ("p", "g", "function"), ("q", "f", "function")]


def test_dirty_files_table(spark):
    import datetime as dt

    rows = [("r", "a.py", None, "h", None, None, None, 1, dt.datetime(2025, 1, 1)), ("r", "a.py", "python", "h2", 3, [], [], 2, dt.datetime(2025, 1, 2)), (None, "x", "go", "h", 1, [], [], 1, None), ("r", "b.zz", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"repo string, path string, language string, content_hash string, lines int, symbols array<{SYM}>, refs array<{index.REFERENCE}>, run_id bigint, indexed_at timestamp")
    got = {r.path: (r.language, r.content_hash, r.lines) for r in index.current_files(df).collect()}
    assert got == {"a.py": ("python", "h2", 3), "b.zz": ("unknown", "", 0)}
    assert graph.build(index.current_files(df.limit(0))).count() == 0
