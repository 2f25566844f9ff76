"""Queries of the text operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_kind, clean_name
from ..session import materialize, table
from .bpe import encode
from .garbled import find, predicted
from .mixing import Mixture
from .provenance import classify_by_method, classify_files
from .terms import marked, remaining_records, term_bitmaps, term_frequencies
from .validity import check_files, rates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_query
def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """Notices and path rules alone, which cannot see files that have neither."""
    return classify_by_method(table(spark, d, "files"))


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_file_sorts(spark, d).filter("sort <> 'hand_written'").select("file_id")


@_query
def p2_file_sorts(spark: SparkSession, d: str) -> DataFrame:
    return classify_files(table(spark, d, "files"), table(spark, d, "upstream_files"))


# JavaScript is judged as a module whatever the extension, so only TypeScript's own extension brings JSX with it.
_MARKUP = (".tsx",)


@_query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return check_files(table(spark, d, "files"), detail=False, markup=_MARKUP).filter("NOT valid").select("file_id")


@_query
def p3_invalid_files(spark: SparkSession, d: str) -> DataFrame:
    return check_files(table(spark, d, "files"), markup=_MARKUP).filter("NOT valid")


@_query
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(check_files(table(spark, d, "files"), detail=False, markup=_MARKUP))


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_term_frequencies(spark, d).filter("mark IS NOT NULL").select("kind", "name", "mark")


@_query
def p5_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols").select(
        F.col("symbol_id").alias("id"), F.col("file_id").alias("record"), clean_kind("kind").alias("kind"), clean_name("name").alias("name")
    )
    bitmaps = materialize(term_bitmaps(symbols), "bitmaps")
    return marked(term_frequencies(bitmaps), remaining_records(bitmaps).scalar())


_TERMS_SQL = """
WITH u AS (
  SELECT DISTINCT symbol_id, file_id, lower(trim(kind, ' ' || chr(9))) AS kind, trim(name, ' ' || chr(9)) AS name
  FROM symbols WHERE kind IS NOT NULL AND name IS NOT NULL
), t AS (
  SELECT kind, name, count(*) AS occurrences, count(DISTINCT file_id) AS n_files FROM u GROUP BY kind, name
), m AS (
  SELECT *, CASE WHEN n_files = 1 THEN 'rare' WHEN n_files >= 0.05 * (SELECT count(DISTINCT file_id) FROM u) THEN 'common' END AS mark FROM t)
"""
SQL["p5_found"] = _TERMS_SQL + "SELECT kind, name, mark FROM m WHERE mark IS NOT NULL"
SQL["p5_term_frequencies"] = _TERMS_SQL + "SELECT kind, name, occurrences, n_files, mark FROM m"


@_query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@_query
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).mixture()


@_query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


@_query
def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each speech was used, against its source's cap."""
    return _mixture(spark, d).doc_uses()


@_query
def p8_method(spark: SparkSession, d: str) -> DataFrame:
    """The classifier's word alone, before words and bigrams counted over all texts decide."""
    return predicted(table(spark, d, "documents"))


@_query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find(table(spark, d, "documents")).select("doc_id")


@_query
def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return find(table(spark, d, "documents"))
