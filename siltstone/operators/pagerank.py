"""Weighted PageRank of every repository's graph at once, optionally personalized.

Graphs whose number of edges was checked to be small run in one Arrow kernel per repository; the
others run as one distributed loop over all of them, in which a step refers to the state once and
the state is written to the shared folder, so neither lineage nor estimates grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch_dir

ALPHA, MAX_STEPS, TOLERANCE = 0.85, 100, 1e-6
KERNEL_EDGES = 500_000


def start_vector(nodes: DataFrame, personal: DataFrame | None = None) -> DataFrame:
    """``repo, path, p``: personal weights normalised per repository, uniform where there are none.

    ``personal`` has ``repo, path, w``; negative weights count as 0.
    """
    size = nodes.groupBy(F.col("repo").alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    base = nodes.select("repo", "path")
    if personal is None:
        return base.join(size, F.col("repo") == F.col("_r")).select("repo", "path", (1.0 / F.col("n")).alias("p"))
    w = personal.select(F.col("repo").alias("_pr"), F.col("path").alias("_pp"), F.greatest("w", F.lit(0.0)).alias("w"))
    each = base.join(w, (F.col("repo") == F.col("_pr")) & (F.col("path") == F.col("_pp")), "left").select("repo", "path", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = each.groupBy(F.col("repo").alias("_r")).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    return each.join(total, F.col("repo") == F.col("_r")).select("repo", "path", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1.0 / F.col("n")).alias("p"))


def links_of(weights: DataFrame) -> DataFrame:
    """``repo, src, dst, share``: every edge with its share of what leaves its source; a row an edge, so that a hub's can be split."""
    out = weights.groupBy(F.col("repo").alias("_r"), F.col("src").alias("_s")).agg(F.sum("weight").alias("total"))
    return weights.join(out, (F.col("repo") == F.col("_r")) & (F.col("src") == F.col("_s"))).select("repo", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def step(state: DataFrame, links: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One iteration on ``repo, path, p, sink, x``; adds the change as ``delta``. Along the edges only ranks move.

    The mass of nodes without outgoing edges is a sum per repository, joined back as one row each.
    """
    lost = state.filter("sink").groupBy(F.col("repo").alias("_l")).agg(F.sum("x").alias("lost"))
    x = state.select(F.col("repo").alias("_r"), F.col("path").alias("_s"), "x")
    sent = links.join(x, (F.col("repo") == F.col("_r")) & (F.col("src") == F.col("_s")))
    got = sent.groupBy(F.col("repo").alias("_g"), F.col("dst").alias("_d")).agg((F.sum(F.col("x") * F.col("share")) * alpha).alias("got"))
    met = state.join(got, (F.col("repo") == F.col("_g")) & (F.col("path") == F.col("_d")), "left").join(lost, F.col("repo") == F.col("_l"), "left")
    new = (1 - alpha) * F.col("p") + F.coalesce("got", F.lit(0.0)) + alpha * F.coalesce("lost", F.lit(0.0)) * F.col("p")
    return met.select("repo", "path", "p", "sink", new.alias("x"), F.abs(new - F.col("x")).alias("delta"))


def _normalised(state: DataFrame) -> DataFrame:
    total = state.groupBy(F.col("repo").alias("_r")).agg(F.sum("x").alias("total"))
    return state.join(total, F.col("repo") == F.col("_r")).select("repo", "path", F.when(F.col("total") > 0, F.col("x") / F.col("total")).otherwise(F.col("x")).alias("score"))


def distributed(start: DataFrame, weights: DataFrame, alpha: float = ALPHA, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The loop over large graphs: a repository stops when its change is below its nodes times the tolerance.

    Finished repositories are appended to one folder; of the states written only the last is kept.
    """
    spark = start.sparkSession
    links = materialize(links_of(weights), "links")
    sources = links.select(F.col("repo").alias("_r"), F.col("src").alias("_s"), F.lit(False).alias("_out")).distinct()
    state = start.join(sources, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_s")), "left")
    state = materialize(state.select("repo", "path", "p", F.coalesce("_out", F.lit(True)).alias("sink"), F.col("p").alias("x"), F.lit(0.0).alias("delta")), "pagerank")
    done, shape = scratch_dir(spark, "ranks"), "repo string, path string, x double"
    for k in range(max_steps):
        new = materialize(step(state, links, alpha), "pagerank")
        discard(state)
        change = new.groupBy(F.col("repo").alias("_r")).agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n"))
        change = change.select("_r", F.expr(f"d < n * {tolerance}D or {str(k == max_steps - 1).lower()}").alias("stop"))
        stopped, moving = change.agg(F.count_if("stop"), F.count_if(~F.col("stop"))).first()  # two numbers
        within = lambda which: new.join(change.filter(which), F.col("repo") == F.col("_r"), "left_semi")  # noqa: B023, E731
        if stopped:
            within("stop").select("repo", "path", "x").write.mode("append").parquet(done)
        state = materialize(within("not stop"), "pagerank") if stopped and moving else new
        if state is not new:
            discard(new)
        if not moving:
            break
    discard(state)
    discard(links)
    return _normalised(spark.read.schema(shape).parquet(done))


def power_iteration(p: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, alpha: float = ALPHA, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The same iteration on arrays; ``p`` is the start vector."""
    n = len(p)
    if n <= 1:
        return np.ones(n)
    out = np.bincount(src, w, n)
    share = alpha * w / out[src]
    dangling = out <= 0
    x = p.copy()
    for _ in range(max_steps):
        new = (1 - alpha) * p + alpha * x[dangling].sum() * p + np.bincount(dst, share * x[src], n)
        error = np.abs(new - x).sum()
        x = new
        if error < n * tolerance:
            break
    return x / x.sum() if x.sum() > 0 else x


def _kernel(alpha: float, max_steps: int, tolerance: float):
    def run(group: pa.Table) -> pa.Table:
        path, p, src, dst, w = (group.column(c).combine_chunks() for c in ("path", "p", "src", "dst", "weight"))
        is_node = p.is_valid().to_numpy(zero_copy_only=False)
        nodes = path.filter(pa.array(is_node))
        index = {v: i for i, v in enumerate(nodes.to_pylist())}
        edge = pa.array(~is_node)
        code = lambda a: np.array([index[v] for v in a.filter(edge).to_pylist()], np.int64)
        x = power_iteration(p.filter(pa.array(is_node)).to_numpy(), code(src), code(dst), w.filter(edge).to_numpy(), alpha, max_steps, tolerance)
        return pa.table({"repo": pa.array([group.column("repo")[0].as_py()] * len(nodes), pa.string()), "path": nodes, "score": x})

    return run


def pagerank(
    nodes: DataFrame, weights: DataFrame, personal: DataFrame | None = None, alpha: float = ALPHA, kernel_edges: int = KERNEL_EDGES, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``repo, path, score`` of every node, adding up to 1 in each repository.

    A repository of one node scores 1; an empty graph gives no rows. Personal weights that add up to
    nothing count as none.
    """
    start = start_vector(nodes, personal)
    sizes = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    edges = weights.groupBy(F.col("repo").alias("_r")).agg(F.count(F.lit(1)).alias("m"))
    checked = materialize(sizes.join(edges, F.col("repo") == F.col("_r"), "left").select("repo", (F.col("n") + F.coalesce("m", F.lit(0)) <= kernel_edges).alias("small")), "sizes")
    small, large = checked.filter("small").select(F.col("repo").alias("_k")), checked.filter("not small").select(F.col("repo").alias("_k"))
    keep = lambda df, which: df.join(which, F.col("repo") == F.col("_k"), "left_semi")
    none = F.lit(None)
    rows = keep(start, small).select("repo", "path", "p", none.cast("string").alias("src"), none.cast("string").alias("dst"), none.cast("double").alias("weight"))
    arcs = keep(weights, small).select("repo", none.cast("string").alias("path"), none.cast("double").alias("p"), "src", "dst", "weight")
    out = rows.unionByName(arcs).groupBy("repo").applyInArrow(_kernel(alpha, max_steps, tolerance), "repo string, path string, score double")
    if large.isEmpty():
        return out
    return out.unionByName(distributed(keep(start, large), keep(weights, large), alpha, max_steps, tolerance))
