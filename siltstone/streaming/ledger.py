"""Processing only new or changed records, with a ledger of sequence-number intervals.

The ledger holds the sequence numbers that have been processed as disjoint half-open intervals.
A run subtracts them from the available numbers, processes exactly the gaps (late commits lie in
old gaps and are picked up like new ones), and commits output and merged intervals in one step:
the output is written beside the ledger, and a manifest that appears in one step makes both visible. A
run that fails at any moment leaves no manifest, so its numbers stay in the gaps.

Number space is cut into blocks of ``BLOCK`` numbers; a block is one row with two arrays of
bounds. All interval arithmetic is per block and vectorised, so blocks spread over the cluster
and a block never holds more than ``BLOCK`` numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from ..sources.store import Store

BLOCK = 1 << 16
_SPANS = "block bigint, lo array<bigint>, hi array<bigint>"


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers as disjoint half-open intervals."""
    if not len(numbers):
        return numbers, numbers
    cut = np.flatnonzero(np.diff(numbers) != 1)
    return numbers[np.r_[0, cut + 1]], numbers[np.r_[cut, len(numbers) - 1]] + 1


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, overlapping and touching ones joined."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]
    return lo[new], hi[last]


def subtract_spans(lo: np.ndarray, hi: np.ndarray, out_lo: np.ndarray, out_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint sorted intervals minus disjoint sorted intervals, by a sweep over the bounds."""
    bounds = np.r_[lo, hi, out_lo, out_hi]
    step = np.r_[np.ones(len(lo), int), -np.ones(len(hi), int), np.full(len(out_lo), -2), np.full(len(out_hi), 2)]
    order = np.argsort(bounds, kind="stable")
    at, level = bounds[order], np.cumsum(step[order])
    inside = (level[:-1] == 1) & (at[1:] > at[:-1])
    return merge_spans(at[:-1][inside], at[1:][inside])


def spans_of(numbers: DataFrame, column: str) -> DataFrame:
    """The distinct non-null numbers of a column as intervals: one row ``block, lo[], hi[]`` per block."""
    n = F.col(column).cast("bigint")

    def fold(group: pa.Table) -> pa.Table:
        v = np.unique(group.column("n").to_numpy())
        lo, hi = _runs(v)
        return pa.table({"block": [int(v[0]) // BLOCK], "lo": [lo.tolist()], "hi": [hi.tolist()]})

    distinct = numbers.select(n.alias("n")).filter(F.col("n").isNotNull()).distinct()
    return distinct.select("n", F.floor(F.col("n") / BLOCK).cast("bigint").alias("block")).groupBy("block").applyInArrow(fold, _SPANS)


def _combine(left: DataFrame, right: DataFrame, op) -> DataFrame:
    r = right.select(F.col("block").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    joined = left.join(r, F.col("block") == F.col("_b"), "full_outer").select(
        F.coalesce("block", "_b").alias("block"), "lo", "hi", "_lo", "_hi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"block": [], "lo": [], "hi": []}
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                lo, hi = op(*(np.array(x or [], np.int64) for x in row[1:]))
                if len(lo):
                    out["block"].append(row[0])
                    out["lo"].append(lo.tolist())
                    out["hi"].append(hi.tolist())
            longs = pa.list_(pa.int64())
            yield pa.record_batch([pa.array(out["block"], pa.int64()), pa.array(out["lo"], longs), pa.array(out["hi"], longs)], ["block", "lo", "hi"])

    return joined.mapInArrow(run, _SPANS)


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Available minus processed, both as interval blocks."""
    return _combine(available, processed, subtract_spans)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two sets of interval blocks."""
    return _combine(left, right, lambda a, b, c, d: merge_spans(np.r_[a, c], np.r_[b, d]))


def spans(blocks: DataFrame) -> DataFrame:
    """Interval blocks as rows ``lo, hi`` (half-open); intervals of neighbouring blocks stay cut at the block bound."""
    return blocks.select(F.explode(F.arrays_zip("lo", "hi")).alias("z")).select("z.lo", "z.hi")


def rows_in(rows: DataFrame, column: str, gaps: DataFrame) -> DataFrame:
    """The rows whose number lies in a gap.

    Gaps are expanded back to numbers block by block (at most ``BLOCK`` a block) and semi-joined,
    an equi-join on the number, which spreads evenly.
    """
    want = spans(gaps).select(F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("_n"))
    return rows.join(want, rows[column].cast("bigint") == want["_n"], "left_semi")


def succeeded_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (repo, path) the latest row of a succeeded run: ``repo, path, f_hash, indexed_at``."""
    good = runs.filter(F.lower(F.trim("status")) == "succeeded").select(F.col("run_id").alias("_run")).distinct()
    rows = files.select("repo", normalize_path("path").alias("path"), "run_id", F.lower("content_hash").alias("f_hash"), "indexed_at")
    return (
        rows.join(good, rows["run_id"] == good["_run"], "left_semi")
        .filter(F.col("indexed_at").isNotNull())
        .groupBy("repo", "path")
        .agg(F.max(F.struct("indexed_at", "f_hash")).alias("r"))
        .select("repo", "path", "r.f_hash", "r.indexed_at")
    )


def scan_verdicts(scans: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """Every scan with whether it is settled: ``scan_id, repo, path, settled``.

    A scan is settled when a later scan of its file supersedes it, when it saw a deletion, or when
    a succeeded run indexed the file at or after it or with the same content (hash case aside).
    """
    s = scans.select(
        F.col("scan_id").cast("bigint").alias("scan_id"), "repo", normalize_path("path").alias("path"),
        F.lower("content_hash").alias("s_hash"), F.coalesce("is_deleted", F.lit(False)).alias("gone"), "seen_at",
    ).filter(F.col("scan_id").isNotNull() & F.col("repo").isNotNull() & F.col("path").isNotNull() & F.col("seen_at").isNotNull())
    # Only the last scan of a file is aggregated, in parts before anything moves; the scans are joined to it, so no history is gathered.
    history = s.groupBy("repo", "path").agg(F.max(F.struct("seen_at", "scan_id", "gone", "s_hash")).alias("last"))
    state = succeeded_state(files, runs).select(F.col("repo").alias("_repo"), F.col("path").alias("_path"), "f_hash", "indexed_at")
    joined = history.join(state, (F.col("repo") == F.col("_repo")) & (F.col("path") == F.col("_path")), "left")
    same = F.col("last.s_hash").eqNullSafe(F.col("f_hash"))
    due = ~F.col("last.gone") & (F.col("indexed_at").isNull() | ((F.col("indexed_at") < F.col("last.seen_at")) & ~same))
    files_due = joined.select("repo", "path", F.col("last.scan_id").alias("last_id"), due.alias("due"))
    return s.select("scan_id", "repo", "path").distinct().join(files_due, ["repo", "path"]).select(
        "scan_id", "repo", "path", (~F.col("due") | (F.col("scan_id") != F.col("last_id"))).alias("settled")
    )


def pending_scans(scans: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """The scans the next run must process: ``scan_id, repo, path``, one per changed file.

    What is due is decided by content hashes and times of the index, which no set of sequence numbers
    can tell; ``ledger_runs`` has the records processed by intervals.

    Defined cases: scans without an id, repository, path or time cannot be placed and are left out;
    repeated rows of one scan count once; a null hash equals only a null hash; a null ``is_deleted``
    is no deletion; files never scanned are no cases; empty tables give an empty result.
    """
    return scan_verdicts(scans, files, runs).filter("NOT settled").select("scan_id", "repo", "path").distinct()


def ledger_runs(scans: DataFrame, files: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """All scans processed through a ledger at ``root`` in three runs: ``scan_id, repo, path, pending``.

    The first run sees the scans that arrived in the first half of the time they cover, the second
    all, and fails after its output is written and before it is committed, the third all again: what
    the second left, late arrivals in old gaps among it, is processed exactly once. Processing a scan
    finds out whether its file is due by it (``pending``). Scans that ``pending_scans`` cannot place
    have no verdict and are left out of the output; their numbers count as processed.
    """
    ledger = IntervalLedger(scans.sparkSession, root)
    verdicts = scan_verdicts(scans, files, runs).select(F.col("scan_id").alias("_id"), "repo", "path", (~F.col("settled")).alias("pending"))

    def process(rows: DataFrame) -> DataFrame:
        ids = rows.select(F.col("scan_id").cast("bigint").alias("scan_id")).distinct()
        return ids.join(verdicts, F.col("scan_id") == F.col("_id")).select("scan_id", "repo", "path", "pending")

    class Lost(Exception):
        pass

    def lose() -> None:
        raise Lost

    numbered = scans.select("scan_id", "arrived_at")
    bound = numbered.agg(F.expr("min(arrived_at) + (max(arrived_at) - min(arrived_at)) / 2")).first()[0]  # one moment
    ledger.run(numbered.filter(F.col("arrived_at") <= F.lit(bound)), "scan_id", process)
    try:
        ledger.run(numbered, "scan_id", process, before_commit=lose)
    except Lost:
        pass
    ledger.run(numbered, "scan_id", process)
    return ledger.read_outputs("scan_id bigint, repo string, path string, pending boolean")


class IntervalLedger:
    """A ledger folder on shared storage; versions are manifests ``v<N>.json``, each taken once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.root = self.store.root

    def manifest(self) -> dict:
        """The latest committed manifest, or one of an empty ledger."""
        versions = self.store.versions()
        return json.loads(self.store.read(f"v{versions[-1]}.json")) if versions else {"version": 0, "spans": None, "outputs": []}

    def processed(self) -> DataFrame:
        at = self.manifest()["spans"]
        return self.spark.read.schema(_SPANS).parquet(at) if at else self.spark.createDataFrame([], _SPANS)

    def outputs(self) -> list[str]:
        """Folders of committed outputs; anything else in the ledger's folder is debris of failed runs."""
        return self.manifest()["outputs"]

    def read_outputs(self, schema: str) -> DataFrame:
        """The rows of all committed outputs."""
        at = self.outputs()
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def run(self, rows: DataFrame, column: str, process: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> int:
        """Process the unprocessed rows and commit; returns the new version (or the old, with nothing to do).

        Another run may commit meanwhile: taking a version that exists fails, and this run's output
        is then left uncommitted, so no record is processed into two committed outputs. ``before_commit``
        runs between output and commit. Rows without a number cannot be told processed from unprocessed
        and are left out. The rows are read twice, their numbers first, so they must be the same each time.
        """
        before = self.manifest()
        gaps = subtract(spans_of(rows, column), self.processed())
        tag = uuid.uuid4().hex
        gaps_at, spans_at, out_at = (f"{self.root}/{kind}-{tag}" for kind in ("gaps", "spans", "output"))
        gaps.write.parquet(gaps_at)
        gaps = self.spark.read.schema(_SPANS).parquet(gaps_at)
        if gaps.isEmpty():
            return before["version"]
        process(rows_in(rows, column, gaps)).write.parquet(out_at)
        union(self.processed(), gaps).write.parquet(spans_at)
        after = {"version": before["version"] + 1, "spans": spans_at, "outputs": [*before["outputs"], out_at]}
        if before_commit:
            before_commit()
        if not self.store.take(f"v{after['version']}.json", json.dumps(after)):
            raise RuntimeError(f"version {after['version']} was committed by another run")
        return after["version"]
