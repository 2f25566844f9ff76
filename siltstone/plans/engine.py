"""The engine: index a repository, then ask for context, ranks and evidence."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CacheError, SiltstoneError
from ..extract.operator import extract
from ..functions.tokens import TokenCounter, default_counter
from ..operators import evidence, graph, rank
from ..operators.index import FILES
from ..operators.lexical import words_of
from ..session import materialize, ship
from ..sources.scan import describe, read_repository
from ..sources.snapshot import Snapshot, diff, resolve_cache_dir
from .render import Item, candidate_limit, render

log = logging.getLogger("siltstone")


class Engine:
    """An indexed repository.

    ``cache=False`` keeps no snapshot; ``languages`` restricts what is indexed; ``counter`` counts tokens.
    """

    def __init__(self, spark: SparkSession, repo_path: str, cache: bool = True, cache_dir: str | None = None, languages: Sequence[str] | None = None, counter: TokenCounter | None = None):
        if not os.path.isdir(repo_path):
            raise SiltstoneError(f"no such folder: {repo_path}")
        ship(spark)
        self.spark = spark
        self.root = os.path.realpath(repo_path)
        self.languages = list(languages) if languages else None
        self.cache_dir = resolve_cache_dir(self.root, cache_dir) if cache else None
        self.count = counter or default_counter()
        self.refresh()

    def refresh(self) -> None:
        """Index again: only new and changed files are scanned, files that are gone leave the index."""
        began = time.time()
        contents = read_repository(self.spark, self.root, self.languages)
        snapshot = None
        if self.cache_dir:
            try:
                snapshot = Snapshot(self.spark, self.cache_dir)
            except (CacheError, OSError) as e:
                log.warning("indexing without a snapshot: %s", e)
        known = snapshot.get_all() if snapshot else self.spark.createDataFrame([], FILES)
        current = materialize(describe(contents), "listing")
        states = materialize(diff(current.filter("language <> 'binary'"), known), "states")
        at = lambda d, s: d.join(states.filter(F.col("state") == s).select(F.col("repo").alias("_r"), F.col("path").alias("_p")), (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left_semi")
        fresh = materialize(extract(at(contents, "miss")), "extracted")
        empty = "cast(array() as {})"
        schema = {f.name: f.dataType.simpleString() for f in fresh.schema}
        binary = current.filter("language = 'binary'").select("*", F.expr(empty.format(schema["symbols"])).alias("symbols"), F.expr(empty.format(schema["refs"])).alias("refs"))
        hits = at(known, "hit")
        counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        parsed = hits.unionByName(fresh)
        self.files = materialize(parsed.unionByName(binary), "files")
        if snapshot:
            if counts.get("miss") or counts.get("stale"):
                snapshot.write(self.files.filter("language <> 'binary'"))
            snapshot.close()
        self.edges = materialize(graph.build(self.files), "edges")
        self.nodes = materialize(graph.nodes_of(self.files, self.edges), "nodes")
        self._hits, self._misses = counts.get("hit", 0), counts.get("miss", 0)
        self._ms = (time.time() - began) * 1000

    @property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges."""
        return self.nodes, self.edges

    @property
    def symbols(self) -> DataFrame:
        """``path, symbols`` of every file."""
        return self.files.select("path", "symbols")

    @property
    def stats(self) -> dict:
        """Counts of files, symbols and edges, files by language, snapshot hits and misses, and the time the index took."""
        n, s = self.files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("symbols")), F.lit(0))).first()
        by = {r[0]: r[1] for r in self.files.groupBy("language").count().collect()}
        return {"files": n, "symbols": s, "edges": self.edges.count(), "languages": by, "cache_hits": self._hits, "cache_misses": self._misses, "index_time_ms": self._ms}

    def query(self, text: str, token_budget: int = 4096, format: str = "markdown") -> str:
        """Context for a question in words; blank text gives an empty string."""
        self._check(token_budget)
        if not text or not text.strip():
            return ""
        return self._render(rank.rank_for_query(self.files, self.edges, text), token_budget, format)

    def context_for(self, files: Sequence[str], token_budget: int = 4096, format: str = "markdown") -> str:
        """Context around files; unknown ones are skipped."""
        self._check(token_budget)
        if not files:
            return ""
        seeds, missing = self._seeds(files)
        for p in missing:
            log.warning("not in the index: %s", p)
        if len(missing) == len(set(files)):
            return json.dumps({"files": [], "error": "No matching files found"}) if format == "json" else "<!-- No matching files found in index -->"
        return self._render(rank.rank_for_files(self.files, self.edges, seeds), token_budget, format)

    def repo_map(self, token_budget: int = 2048, format: str = "markdown") -> str:
        """The repository's files by structural importance."""
        self._check(token_budget)
        return self._render(rank.rank_structure(self.nodes, self.edges), token_budget, format)

    def evidence_for_query(self, text: str, limit: int = 8, symbol_limit: int = 5, neighbor_limit: int = 3) -> dict:
        """A structured evidence pack for a question."""
        empty = {"mode": "query", "query": text, "seed_files": [], "confidence": 0.0, "matched_terms": [], "missed_terms": [], "files": []}
        if not text or not words_of(text):
            return empty
        got = evidence.query_evidence(self.files, self.edges, text, limit, symbol_limit, neighbor_limit).first()
        return {**empty, **_plain(got)} if got else {**empty, "missed_terms": list(dict.fromkeys(words_of(text)))}

    def evidence_for_files(self, files: Sequence[str], limit: int = 8, symbol_limit: int = 5, neighbor_limit: int = 3) -> dict:
        """A structured evidence pack around files."""
        empty = {"mode": "files", "query": None, "seed_files": [], "confidence": 0.0, "matched_terms": [], "missed_terms": [], "files": []}
        seeds, missing = self._seeds(files)
        got = evidence.file_evidence(self.files, self.edges, seeds, limit, symbol_limit, neighbor_limit).first() if files else None
        out = {**empty, **_plain(got)} if got else empty
        return {**out, "seed_files": [p for p in files if p not in missing]}

    @staticmethod
    def _check(budget: int) -> None:
        if budget <= 0:
            raise SiltstoneError("the token budget must be positive")

    def _seeds(self, files: Sequence[str]) -> tuple[DataFrame, set[str]]:
        given = self.spark.createDataFrame([("", p) for p in dict.fromkeys(files)], "repo string, path string")
        known = given.join(self.files.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_semi")
        return given, set(files) - {r["path"] for r in known.collect()}

    def _render(self, scores: DataFrame, budget: int, format: str) -> str:
        total = self.nodes.count()
        order = (F.desc(F.round("score", 12)), F.asc("path"))
        top = scores.orderBy(*order).limit(candidate_limit(budget))
        info = self.files.select(F.col("path").alias("_p"), "language", "symbols")
        rows = top.join(info, F.col("path") == F.col("_p"), "left").orderBy(*order).collect()
        items = [Item(r["path"], r["score"], r["language"] or "unknown", [s.asDict() for s in r["symbols"] or []], r["_p"] is not None) for r in rows]
        return render(items, total, budget, format, self.count)


def _plain(row) -> dict:
    d = {k: v for k, v in row.asDict(recursive=True).items() if k != "repo"}
    for f in d["files"]:
        if f["focus_range"]:
            f["focus_range"] = [f["focus_range"]["start"], f["focus_range"]["end"]]
    return d
