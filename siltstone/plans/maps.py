"""Maps of all repositories at once: candidates are cut in the plan, each repository renders in one small group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, default_counter
from ..operators.rank import ranked
from .render import Item, candidate_limit, render


def render_all(files: DataFrame, scores: DataFrame, budget: int, counter: TokenCounter | None = None, kinds: tuple[str, ...] = ("markdown", "json")) -> DataFrame:
    """``repo, files_total, markdown, json`` of every repository with a ranked node.

    Of the two texts only those of ``kinds`` are rendered, the other is null. A group holds at most as many rows as a budget has candidates (128), whatever a repository's size.
    """
    total = scores.groupBy(F.col("repo").alias("_n")).agg(F.count(F.lit(1)).alias("total"))
    info = files.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), "language", "symbols")
    top = ranked(scores, candidate_limit(budget)).join(info, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left").join(total, F.col("repo") == F.col("_n"))
    rows = top.select("repo", "path", "score", "rank", "language", "symbols", "total")

    def run(group: pa.Table) -> pa.Table:
        got = sorted(group.to_pylist(), key=lambda r: r["rank"])
        items = [Item(r["path"], r["score"], r["language"] or "unknown", r["symbols"] or [], r["language"] is not None) for r in got]
        n, count = got[0]["total"], counter or default_counter()
        made = [pa.array([render(items, n, budget, kind, count) if kind in kinds else None], pa.string()) for kind in ("markdown", "json")]
        return pa.table({"repo": pa.array([got[0]["repo"]], pa.string()), "files_total": pa.array([n], pa.int64()), "markdown": made[0], "json": made[1]})

    return rows.groupBy("repo").applyInArrow(run, "repo string, files_total bigint, markdown string, json string")
