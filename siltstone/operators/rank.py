"""Ranks of files: by structure alone, for a query, and for given files.

Everything is per repository. Normalising joins one row per repository; a ranking cut to the first
``top`` of a repository is limited before it is shuffled, a full one is sorted by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import TEST_WORDS
from ..session import materialize
from .graph import neighbors, nodes_of, weights_of
from .lexical import lexical, words_of
from .pagerank import ALPHA, pagerank

DECAY = 0.6
QUERY_MIX = (6.0, 1.5, 0.5)  # lexical, nearby, structural
FILES_MIX = (5.0, 2.5, 1.0)  # seeds, nearby, structural


def max_normalised(scores: DataFrame, column: str) -> DataFrame:
    """``repo, path, <column>`` divided by the repository's maximum; all 0 where that is not positive."""
    top = scores.groupBy(F.col("repo").alias("_m")).agg(F.max(column).alias("_max"))
    value = F.when(F.col("_max") > 0, F.col(column) / F.col("_max")).otherwise(0.0)
    return scores.join(top, F.col("repo") == F.col("_m")).select("repo", "path", value.alias(column))


def expand(seeds: DataFrame, near: DataFrame, hops: int = 2, decay: float = DECAY) -> DataFrame:
    """Relevance of seeds spread over undirected edges: ``repo, path, score``.

    ``seeds`` is ``repo, path, score``, ``near`` is ``neighbors``. The value of a node is the greatest
    seed times ``decay`` per hop; seeds of 0 stay with 0. With a decay below 1 the shortest way is the
    best one, so each hop is one join and one maximum.
    """
    reached, front = seeds, seeds
    for _ in range(hops):
        n = near.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), "other")
        moved = front.filter("score > 0").join(n, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")))
        front = moved.groupBy("repo", F.col("other").alias("path")).agg((F.max("score") * decay).alias("score"))
        reached = reached.unionByName(front)
    return reached.groupBy("repo", "path").agg(F.max("score").alias("score"))


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """``repo, path, score, rank`` by descending score, ties by path; the first ``top`` of a repository.

    A full ranking is cut into ranges of (repository, score, path); a row's rank is its place in its
    range plus what lies before it, so no repository is sorted in one task. Scores that differ by less
    than the noise of sums taken in another order count as equal.
    """
    order = [F.desc(F.round("score", 12)), F.asc("path")]
    if top is not None:
        place = F.row_number().over(Window.partitionBy("repo").orderBy(*order)).alias("rank")
        return scores.select("repo", "path", "score", place).filter(F.col("rank") <= top)
    n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = scores.select("repo", "path", "score").repartitionByRange(n, "repo", *order).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    sizes = ranges.groupBy(F.col("repo").alias("_s"), F.col("_range").alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_s", "_k", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("repo", "_range").orderBy(*order))
    joined = ranges.withColumn("place", place).join(offsets, F.col("repo").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_k")))
    return joined.select("repo", "path", "score", (F.col("before") + F.col("place")).cast("int").alias("rank"))


def rank_structure(nodes: DataFrame, edges: DataFrame, personal: DataFrame | None = None, steps: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """``repo, path, score`` by PageRank, until it stands still or for a fixed number of steps."""
    if steps is None:
        return pagerank(nodes, weights_of(edges), personal, alpha)
    return pagerank(nodes, weights_of(edges), personal, alpha, max_steps=steps, tolerance=0.0)


def _mix(parts: list[tuple[float, DataFrame, str]]) -> DataFrame:
    each = [d.select("repo", "path", (F.col(c) * w).alias("score")) for w, d, c in parts]
    out = each[0]
    for d in each[1:]:
        out = out.unionByName(d)
    return out.groupBy("repo", "path").agg(F.sum("score").alias("score"))


def rank_for_query(files: DataFrame, edges: DataFrame, query: str, steps: int | None = None) -> DataFrame:
    """``repo, path, score`` for a query: lexical score, its spread, and PageRank personalized by it.

    In repositories without a lexical hit the structure alone ranks. Unless the query asks for tests,
    paths of tests are damped.
    """
    nodes = materialize(nodes_of(files, edges), "nodes")
    words = words_of(query)
    hits = lexical(files, query)
    whole = nodes.join(hits.withColumnsRenamed({"repo": "_r", "path": "_p"}), (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left").select(
        "repo", "path", F.coalesce("lexical", F.lit(0.0)).alias("lexical")
    )
    whole = materialize(whole, "lexical")
    norm = max_normalised(whole, "lexical")
    near = max_normalised(expand(norm.withColumnRenamed("lexical", "score"), neighbors(edges)), "score")
    structure = rank_structure(nodes, edges, whole.withColumnRenamed("lexical", "w"), steps)
    mixed = _mix([(QUERY_MIX[0], norm, "lexical"), (QUERY_MIX[1], near, "score"), (QUERY_MIX[2], max_normalised(structure, "score"), "score")])
    damp: Column = F.lit(1.0) if set(words) & set(TEST_WORDS) else F.when(F.expr(t.is_test_path("path")), 0.6).otherwise(1.0)
    hit = norm.groupBy(F.col("repo").alias("_h")).agg((F.max("lexical") > 0).alias("any"))
    plain = structure.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("score").alias("plain"))
    joined = mixed.join(hit, F.col("repo") == F.col("_h")).join(plain, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")))
    return joined.select("repo", "path", F.when(F.col("any"), F.col("score") * damp).otherwise(F.col("plain")).alias("score"))


def rank_for_files(files: DataFrame, edges: DataFrame, seeds: DataFrame, steps: int | None = None) -> DataFrame:
    """``repo, path, score`` around seed files (``repo, path``): seeds, their neighbourhood, personalized PageRank.

    In repositories without a seed the structure alone ranks; tests are not damped.
    """
    nodes = materialize(nodes_of(files, edges), "nodes")
    s = seeds.select(F.col("repo").alias("_r"), F.col("path").alias("_p")).distinct()
    marked = nodes.join(s, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left").select("repo", "path", F.when(F.col("_r").isNotNull(), 1.0).otherwise(0.0).alias("seed"))
    near = max_normalised(expand(marked.withColumnRenamed("seed", "score"), neighbors(edges)), "score")
    structure = rank_structure(nodes, edges, marked.withColumnRenamed("seed", "w"), steps)
    mixed = _mix([(FILES_MIX[0], marked, "seed"), (FILES_MIX[1], near, "score"), (FILES_MIX[2], max_normalised(structure, "score"), "score")])
    hit = marked.groupBy(F.col("repo").alias("_h")).agg((F.max("seed") > 0).alias("any"))
    plain = structure.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("score").alias("plain"))
    joined = mixed.join(hit, F.col("repo") == F.col("_h")).join(plain, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")))
    return joined.select("repo", "path", F.when(F.col("any"), F.col("score")).otherwise(F.col("plain")).alias("score"))


def _part(c: str, top: str) -> Column:
    return F.when(F.col(top) > 0, F.col(c) / F.col(top)).otherwise(0.0)


def query_score(words: list[str]) -> Column:
    """``rank_for_query`` on the columns of ``factored.scores``, whose values are lexical scores."""
    mixed = QUERY_MIX[0] * _part("value", "top_value") + QUERY_MIX[1] * _part("near", "top_near") + QUERY_MIX[2] * _part("score", "top_score")
    damp: Column = F.lit(1.0) if set(words) & set(TEST_WORDS) else F.when(F.expr(t.is_test_path("path")), 0.6).otherwise(1.0)
    return F.when(F.col("top_value") > 0, mixed * damp).otherwise(F.col("score"))


def files_score() -> Column:
    """``rank_for_files`` on the same columns, whose values are 1 for seeds."""
    mixed = FILES_MIX[0] * F.col("value") + FILES_MIX[1] * _part("near", "top_near") + FILES_MIX[2] * _part("score", "top_score")
    return F.when(F.col("top_value") > 0, mixed).otherwise(F.col("score"))


def tiers(scores: DataFrame) -> DataFrame:
    """``repo, path, score, rank, tier``: the first 30, 60 and 80 percent of a repository's files, then 4."""
    n = scores.groupBy(F.col("repo").alias("_n")).agg(F.count(F.lit(1)).alias("n"))
    r = ranked(scores).join(n, F.col("repo") == F.col("_n"))
    share = lambda x: f"ceil(n * {x}D)"
    t1, t2, t3 = f"greatest(1, {share(0.3)})", f"greatest(1, {share(0.3)}, {share(0.6)})", f"greatest(1, {share(0.3)}, {share(0.6)}, {share(0.8)})"
    tier = F.expr(f"case when rank <= {t1} then 1 when rank <= {t2} then 2 when rank <= {t3} then 3 else 4 end")
    return r.select("repo", "path", "score", "rank", tier.alias("tier"))
