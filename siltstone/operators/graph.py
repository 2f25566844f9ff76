"""The dependency graph: typed edges between files of a repository, test edges, and simple weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import factored
from .index import WEIGHTS

#: Fixed value: extensions a test's source may have, by the test's language.
SOURCE_EXTENSIONS = {"python": (".py",), "typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx"), "go": (".go",), "java": (".java",)}


def test_stem() -> F.Column:
    """The stem of what a test file tests, null for other files."""
    s, b = t.file_stem("path"), t.basename("path")
    bare = f"regexp_replace(regexp_replace({s}, '[.]test$', ''), '[.]spec$', '')"
    return F.expr(f"""case
        when language = 'python' and startswith({s}, 'test_') then substring({s}, 6)
        when language in ('python', 'go') and endswith({s}, '_test') then left({s}, length({s}) - 5)
        when language in ('typescript', 'javascript') and (contains({b}, '.test.') or contains({b}, '.spec.') or concat('/', path) like '%/\\\\_\\\\_tests\\\\_\\\\_/%') then {bare}
        when language = 'java' and endswith({s}, 'Test') then left({s}, length({s}) - 4) end""")


def test_edges(files: DataFrame) -> DataFrame:
    """``repo, src, dst, stem``: each test file with the nearest file of its stem and language.

    Distance is the number of folders up and down. Sources are kept per (stem, folder above) with
    the two best below each, so tests and sources never meet as pairs; ties go to the first path.
    """
    dirs = f"filter(split({t.dirname('path')}, '/'), x -> x <> '.')"
    above = f"transform(sequence(0, size({dirs})), i -> struct(i as depth, array_join(slice({dirs}, 1, i), '/') as dir))"
    of_ext = F.expr("map(" + ", ".join(f"{t.lit(e)}, {t.lit(k)}" for k, es in SOURCE_EXTENSIONS.items() for e in es) + ")")
    sources = files.select(
        F.col("repo").alias("_r"), F.col("path").alias("dst"), F.expr(t.file_stem("path")).alias("_s"), F.expr(f"size({dirs})").alias("len_b"),
        F.try_element_at(of_ext, F.expr("regexp_extract(path, '[^/]([.][^./]+)$', 1)")).alias("_l"), F.explode(F.expr(above)).alias("a"),
    ).filter("_l is not null")
    best = Window.partitionBy("_r", "_l", "_s", "a").orderBy("len_b", "dst")
    near = sources.withColumn("k", F.row_number().over(best)).filter("k <= 2").select("_r", "_l", "_s", F.col("a.dir").alias("_dir"), "len_b", "dst")
    tests = files.select("repo", "path", "language", test_stem().alias("stem"), F.expr(f"size({dirs})").alias("len_a"), F.explode(F.expr(above)).alias("a")).filter("stem is not null")
    same = (F.col("repo") == F.col("_r")) & (F.col("language") == F.col("_l")) & (F.col("stem") == F.col("_s")) & (F.col("a.dir") == F.col("_dir"))
    hits = tests.join(near, same).filter("dst <> path").withColumn("dist", F.expr("len_a + len_b - 2 * a.depth"))
    return hits.groupBy("repo", F.col("path").alias("src")).agg(F.min_by("dst", F.struct("dist", "dst")).alias("dst"), F.first("stem").alias("stem"))


def edges_of(links: DataFrame) -> DataFrame:
    """Links ``repo, src, dst, kind, symbol, ord`` merged to edges ``repo, src, dst, kind, symbols``.

    One edge per kind; its symbols are distinct, in the order first seen; links of a file to itself
    are dropped. Equal links meet before the merge, so an edge's list is as long as its symbols.
    """
    firsts = links.filter("src <> dst").groupBy("repo", "src", "dst", "kind", "symbol").agg(F.min("ord").alias("ord"))
    merged = firsts.groupBy("repo", "src", "dst", "kind").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol"))).alias("s"))
    return merged.select("repo", "src", "dst", "kind", F.expr("transform(s, x -> x.symbol)").alias("symbols"))


def build(files: DataFrame) -> DataFrame:
    """All edges of the files' graph: resolved references and test edges."""
    return factored.edges(factored.parts_of(files))


def nodes_of(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files and all ends of edges: ``repo, path``."""
    ends = edges.select("repo", F.explode(F.array("src", "dst")).alias("path"))
    return files.select("repo", "path").unionByName(ends).distinct()


def weights_of(edges: DataFrame) -> DataFrame:
    """The simple weighted graph: ``repo, src, dst, weight``, weights of parallel kinds added."""
    w = F.expr("coalesce(try_element_at(map(" + ", ".join(f"{t.lit(k)}, {v}D" for k, v in WEIGHTS.items()) + "), kind), 1.0D)")
    return edges.groupBy("repo", "src", "dst").agg(F.sum(w).alias("weight"))


def neighbors(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbourhood: ``repo, path, other``."""
    return edges.select("repo", F.explode(F.array(F.struct(F.col("src").alias("path"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("path"), F.col("src").alias("other")))).alias("e")).select("repo", "e.path", "e.other").distinct()
