"""Structured evidence: symbols, neighbours, reasons and confidence of the files ranked first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import lit, python_compact, string_array
from .lexical import matched_terms, summary, symbol_score, words_of
from .rank import rank_for_files, rank_for_query, ranked

_NONE = "cast(array() as array<string>)"


def evidence_symbols(words: list[str], limit: int = 5) -> str:
    """SQL of a file's evidence symbols from ``symbols``: scored, filtered, ordered, cut to ``limit``.

    Symbols that match nothing are dropped; if none is left, the first of the file stand in, without
    score. Order: score, line, name in lower case.
    """
    one = "named_struct('name', s.name, 'kind', s.kind, 'line', s.line, 'end_line', s.end_line, 'signature', s.signature, 'score', {score}, 'matched_terms', {terms}, 'reasons', {reasons})"
    terms = matched_terms(words, "concat(s.name, ' ', s.signature)")
    parent = "if(s.parent is not null and s.parent <> '', array(concat('member-of:', s.parent)), cast(array() as array<string>))"
    shape = "case when x.score >= 18 then array('exact-symbol-shape') when x.score >= 8 then array('strong-symbol-match') else cast(array() as array<string>) end"
    hit = "if(size(x.terms) > 0, array('query-term-match'), cast(array() as array<string>))"
    scored = f"transform(symbols, s -> named_struct('s', s, 'score', {symbol_score(words)}, 'terms', {terms}))"
    kept = f"filter({scored}, x -> {'x.score > 0 or size(x.terms) > 0' if words else 'true'})"
    full = one.format(score="round(x.score, 4)", terms="x.terms", reasons=f"concat({hit}, {parent.replace('s.', 'x.s.')}, {shape})")
    full = full.replace("s.name", "x.s.name").replace("s.kind", "x.s.kind").replace("s.line", "x.s.line").replace("s.end_line", "x.s.end_line").replace("s.signature", "x.s.signature")
    made = f"transform({kept}, x -> {full})"
    plain = f"transform(slice(symbols, 1, {limit}), s -> {one.format(score='0.0D', terms=_NONE, reasons=_NONE)})"
    order = "(a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.line < b.line then -1 when a.line > b.line then 1 when lower(a.name) < lower(b.name) then -1 when lower(a.name) > lower(b.name) then 1 else 0 end"
    pick = f"transform(array({made}), m -> if(size(m) > 0, m, {plain}))[0]"
    return f"slice(array_sort({pick}, {order}), 1, {limit})"


def evidence_neighbors(edges: DataFrame, limit: int = 3, only: DataFrame | None = None) -> DataFrame:
    """``repo, path, k, other, direction, kind, symbols``: the first ``limit`` neighbours of every file, or of ``only`` some.

    Both directions; at most five symbols each, in order; ordered by their number, path in lower case,
    direction, and kind where all else ties. A file's neighbours are cut by a limited window, never collected.
    """
    five = F.slice(F.array_sort(F.array_distinct("symbols")), 1, 5).alias("symbols")
    out = edges.select("repo", F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("outgoing").alias("direction"), "kind", five)
    into = edges.select("repo", F.col("dst").alias("path"), F.col("src").alias("other"), F.lit("incoming").alias("direction"), "kind", five)
    if only is not None:
        o = only.select(F.col("repo").alias("_r"), F.col("path").alias("_p"))
        here = (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p"))
        out, into = out.join(o, here, "left_semi"), into.join(o, here, "left_semi")
    order = Window.partitionBy("repo", "path").orderBy(F.desc(F.size("symbols")), F.lower("other"), "direction", "kind", "other")
    return out.unionByName(into).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit)


def known_of(ranks: DataFrame, files: DataFrame) -> DataFrame:
    """The ranks of nodes that are files of the index."""
    return ranks.join(files.select(F.col("repo").alias("_r"), F.col("path").alias("_p")), (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left_semi")


def evidence_files(ranks: DataFrame, files: DataFrame, near_of: Callable[[DataFrame], DataFrame], words: list[str], limit: int, symbol_limit: int, seeds: DataFrame | None = None) -> DataFrame:
    """One row per evidence file, the first ``limit`` (one at least) of each repository by rank.

    ``repo, k, path, rank, language, summary, matched_terms, reasons, symbols, neighbors, focus_range``.
    ``ranks`` are of files of the index only; the details are computed for the chosen files only, their
    neighbours by ``near_of``.
    """
    top = ranked(ranks, max(1, limit)).select("repo", "path", F.col("score"), F.col("rank").alias("k"))
    info = files.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), "language", "symbols")
    chosen = top.join(info, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p"))).drop("_r", "_p")
    near = near_of(top).groupBy(F.col("repo").alias("_r"), F.col("path").alias("_p")).agg(
        F.array_sort(F.collect_list(F.struct("k", F.struct(F.col("other").alias("path"), "kind", "direction", "symbols").alias("n")))).alias("ns")
    )
    d = chosen.join(near, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left").drop("_r", "_p")
    if seeds is None:
        d = d.withColumn("is_seed", F.lit(False))
    else:
        s = seeds.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.lit(True).alias("_seed")).distinct()
        d = d.join(s, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left").withColumn("is_seed", F.coalesce("_seed", F.lit(False))).drop("_r", "_p", "_seed")
    neighbor = "array<struct<path:string,kind:string,direction:string,symbols:array<string>>>"
    d = d.withColumns({"neighbors": F.expr(f"coalesce(transform(ns, x -> x.n), cast(array() as {neighbor}))"), "evidence": F.expr(evidence_symbols(words, symbol_limit))})
    q, kws = lit(python_compact("".join(words))), string_array(words)
    in_path = matched_terms(words, "path")
    from_symbols = "array_distinct(flatten(transform(evidence, s -> s.matched_terms)))"
    reasons = f"""concat(
      if(is_seed, array('seed-file'), {_NONE}),
      case when {q} <> '' and {t.compact(t.stem('path'))} = {q} then array('exact-path-shape')
           when {len(words)} > 1 and {t.in_order(t.tokenize(f"lower({t.stem('path')})"), kws)} then array('ordered-path-match') else {_NONE} end,
      if(size({in_path}) > 0 and size({in_path}) = {len(set(words))}, array('full-path-keyword-cover'), {_NONE}),
      if(size({in_path}) > 0, array('path-match'), {_NONE}),
      if(size({from_symbols}) > 0, array('symbol-match'), {_NONE}),
      if(size(neighbors) > 0, array('graph-neighbor'), {_NONE}))"""
    focus = "if(size(evidence) > 0, named_struct('start', array_min(transform(evidence, s -> s.line)), 'end', array_max(transform(evidence, s -> if(s.end_line is null or s.end_line = 0, s.line, s.end_line)))), null)"
    return (
        d.withColumn("found", F.expr(reasons))
        .withColumn("reasons", F.expr("if(size(found) = 0 and size(symbols) > 0, array('structural-rank'), found)"))
        .select(
            "repo", "k", "path", F.bround("score", 6).alias("rank"), "language", F.expr(summary()).alias("summary"),
            F.expr(f"array_sort(array_union({in_path}, {from_symbols}))").alias("matched_terms"), "reasons", F.col("evidence").alias("symbols"), "neighbors",
            F.expr(focus).alias("focus_range"),
        )
    )


def query_evidence(files: DataFrame, edges: DataFrame, query: str, limit: int = 8, symbol_limit: int = 5, neighbor_limit: int = 3) -> DataFrame:
    """One evidence pack per repository: ``repo, mode, query, confidence, files, matched_terms, missed_terms``.

    A query without words has no files and confidence 0.
    """
    ranks = known_of(rank_for_query(files, edges, query), files)
    return query_packs(ranks, files, lambda top: evidence_neighbors(edges, neighbor_limit, top), query, limit, symbol_limit)


def query_packs(ranks: DataFrame, files: DataFrame, near_of: Callable[[DataFrame], DataFrame], query: str, limit: int = 8, symbol_limit: int = 5) -> DataFrame:
    """The same from the ranks of files and their neighbours."""
    words = words_of(query)
    packs = _packs(evidence_files(ranks.filter(F.lit(bool(words))), files, near_of, words, limit, symbol_limit))
    kws = string_array(words)
    covered = "size(array_distinct(flatten(transform(slice(files, 1, 3), f -> f.matched_terms))))"
    first, second = "files[0]", "try_element_at(files, 2).rank"
    margin = f"case when coalesce({second}, 0.0D) <= 0 then 1.0D else least(1.0D, greatest(0.0D, ({first}.rank / {second} - 1.0D) / 1.5D)) end"
    sure = f"""0.2D + 0.35D * ({covered} / {max(1, len(set(words)))}D) + 0.25D * {margin} + if(array_contains({first}.reasons, 'exact-path-shape'), 0.1D, 0.0D)
      + if(array_contains({first}.reasons, 'symbol-match'), 0.1D, 0.0D)"""
    matched = "array_sort(array_distinct(flatten(transform(files, f -> f.matched_terms))))"
    return packs.select(
        "repo", F.lit("query").alias("mode"), F.lit(query).alias("query"), F.expr(f"bround(least(1.0D, greatest(0.0D, {sure})), 3)").alias("confidence"), "files",
        F.expr(matched).alias("matched_terms"), F.expr(f"array_except(array_distinct({kws}), {matched})").alias("missed_terms"),
    )


def file_evidence(files: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int = 8, symbol_limit: int = 5, neighbor_limit: int = 3) -> DataFrame:
    """One evidence pack per repository with a seed: ``repo, mode, confidence, files, seed_files``.

    ``seeds`` is ``repo, path``; seeds that are no files of the index are dropped.
    """
    known = seeds.join(files.select(F.col("repo").alias("_r"), F.col("path").alias("_p")), (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left_semi").distinct()
    ranks = known_of(rank_for_files(files, edges, known), files)
    return file_packs(ranks, files, lambda top: evidence_neighbors(edges, neighbor_limit, top), known, limit, symbol_limit)


def file_packs(ranks: DataFrame, files: DataFrame, near_of: Callable[[DataFrame], DataFrame], known: DataFrame, limit: int = 8, symbol_limit: int = 5) -> DataFrame:
    """The same from the ranks of files and their neighbours; ``known`` are the seeds."""
    of = known.groupBy(F.col("repo").alias("_s")).agg(F.array_sort(F.collect_set("path")).alias("seed_files"))
    scoped = lambda d: d.join(of, d["repo"] == F.col("_s"), "left_semi")
    packs = _packs(evidence_files(scoped(ranks), files, near_of, [], limit, symbol_limit, known)).join(of, F.col("repo") == F.col("_s"))
    seen = "size(array_intersect(seed_files, transform(files, f -> f.path))) / size(seed_files)"
    third = lambda c: f"least(1.0D, size(filter(slice(files, 1, 3), f -> {c})) / 3.0D)"
    sure = f"0.45D + 0.35D * ({seen}) + 0.1D * {third('size(f.neighbors) > 0')} + 0.1D * {third('f.focus_range is not null')}"
    return packs.select("repo", F.lit("files").alias("mode"), F.expr(f"bround(least(1.0D, {sure}), 3)").alias("confidence"), "files", "seed_files")


def _packs(evidence: DataFrame) -> DataFrame:
    """Evidence files gathered per repository; there are at most as many as the limit."""
    cols = [c for c in evidence.columns if c != "repo"]
    gathered = evidence.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("k", F.struct(*[c for c in cols if c != "k"]).alias("f")))).alias("fs"))
    return gathered.select("repo", F.expr("transform(fs, x -> x.f)").alias("files"))
