"""Queries of the core operators for large collections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyagg import heavy_keys, key_totals, name_sides
from ..session import materialize, scratch_dir, table
from ..streaming.ledger import ledger_runs, pending_scans


def _totals(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols").select("symbol_id", "name", "file_id")
    refs = table(spark, d, "refs").select("ref_id", "target_name", "file_id", "target_file")
    return key_totals(name_sides(symbols, refs))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(materialize(_totals(spark, d), "totals")).select("side", "key_name")


def p1_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d).withColumnRenamed("name", "key_name")


def _p4_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "file_scans"), table(spark, d, "files").select("repo", "path", "content_hash", "run_id", "indexed_at"), table(spark, d, "index_runs")


def p4_method(spark: SparkSession, d: str) -> DataFrame:
    """All scans processed by the interval ledger in three runs, the second of which fails before its commit."""
    return ledger_runs(*_p4_tables(spark, d), scratch_dir(spark, "ledger"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pending_scans(*_p4_tables(spark, d)).select("repo", "path").distinct()


def p4_pending_scans(spark: SparkSession, d: str) -> DataFrame:
    return pending_scans(*_p4_tables(spark, d))


_TOTALS_SQL = """
WITH u AS (
  SELECT DISTINCT 'symbol' AS side, symbol_id AS id, trim(name, ' ' || chr(9)) AS key_name, file_id, NULL::VARCHAR AS target FROM symbols WHERE name IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'reference', ref_id, trim(target_name, ' ' || chr(9)), file_id, target_file FROM refs WHERE target_name IS NOT NULL
), k AS (
  SELECT side, key_name, count(*) AS n_rows, count(DISTINCT file_id) AS n_files, count(target) AS n_resolved, count(DISTINCT target) AS n_targets
  FROM u GROUP BY side, key_name)
"""

# The lexical form of a path is folded by repeated replacement of "x/../" after "." and "//" are gone.
_P4_SQL = r"""
WITH RECURSIVE spelled AS (
  SELECT DISTINCT path AS raw, regexp_replace(regexp_replace('/' || replace(path, chr(92), '/') || '/', '/(\./)+', '/', 'g'), '/+', '/', 'g') AS p FROM file_scans
), folded AS (
  SELECT raw, p FROM spelled
  UNION ALL
  SELECT raw, regexp_replace(p, '/[^/]+/\.\./', '/') FROM folded WHERE regexp_matches(p, '/[^/]+/\.\./')
), norm AS (
  SELECT raw, trim(min_by(p, length(p)), '/') AS path FROM folded GROUP BY raw
), last_scan AS (
  SELECT s.repo, n.path, max_by(struct_pack(h := lower(s.content_hash), g := s.is_deleted, t := s.seen_at, i := s.scan_id), (s.seen_at, s.scan_id)) AS l
  FROM file_scans s JOIN norm n ON n.raw = s.path GROUP BY ALL
), state AS (
  SELECT f.repo, f.path, max_by(struct_pack(h := lower(f.content_hash), t := f.indexed_at), f.indexed_at) AS x
  FROM files f JOIN index_runs r ON r.run_id = f.run_id WHERE r.status = 'succeeded' GROUP BY ALL
), pending AS (
  SELECT s.repo, s.path, s.l.i AS scan_id FROM last_scan s LEFT JOIN state f ON f.repo = s.repo AND f.path = s.path
  WHERE NOT s.l.g AND (f.path IS NULL OR (f.x.t < s.l.t AND f.x.h IS DISTINCT FROM s.l.h)))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_key_totals": p1_key_totals,
    "p4_method": p4_method,
    "p4_found": p4_found,
    "p4_pending_scans": p4_pending_scans,
}

SQL = {
    "p1_found": _TOTALS_SQL + "SELECT side, key_name FROM k QUALIFY n_rows >= 0.02 * sum(n_rows) OVER (PARTITION BY side)",
    "p1_key_totals": _TOTALS_SQL + "SELECT side, key_name, n_rows, n_files, n_resolved, n_targets FROM k",
    "p4_method": _P4_SQL + "SELECT DISTINCT s.scan_id, s.repo, n.path, p.scan_id IS NOT NULL AS pending FROM file_scans s JOIN norm n ON n.raw = s.path LEFT JOIN pending p ON p.scan_id = s.scan_id AND p.repo = s.repo AND p.path = n.path",
    "p4_found": _P4_SQL + "SELECT DISTINCT repo, path FROM pending",
    "p4_pending_scans": _P4_SQL + "SELECT scan_id, repo, path FROM pending",
}
