"""Queries of the index, graph, ranking and evidence operators over whole tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.scanner import IMPORT_PATTERNS
from ..functions import text as t
from ..functions.tokens import estimate
from ..operators import evidence, factored, graph, index, lexical, rank, resolve
from ..session import materialize, table

QUERY = "parse invoice handler"
TEST_QUERY = "invoice test"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current files with the named columns, by default all."""
    return index.current_files(table(spark, d, "files"), columns or index.COLUMNS)


def indexed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current files, written once because a query refers to them several times."""
    return materialize(files(spark, d, *columns), "files")


def parts(spark: SparkSession, d: str, value="0.0D", first: bool = False, loop: bool = False) -> DataFrame:
    """The graph of a folder in factors, built from the tables by every query that asks for it."""
    return factored.parts_of(table(spark, d, "files"), value, first, loop=loop)


#: A file's number for queries around tests.
_TEST_FILE = f"if({t.is_test_path('path')}, 1.0D, 0.0D)"


BASE = r"""
WITH RECURSIVE f AS (
  SELECT DISTINCT ON (repo, path) repo, path, content,
    coalesce(language, CASE regexp_extract(lower(path), '[^/]+(\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript'
      WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' ELSE 'javascript' END) AS language, symbols, refs
  FROM files ORDER BY repo, path, indexed_at DESC, run_id DESC
), s AS (SELECT repo, path, u.name, u.kind, u.line, u.signature, u.parent, u.end_line, u.ord FROM (SELECT repo, path, unnest(symbols) AS u FROM f)
), r AS (SELECT repo, path, language, u.target_name, u.target_file, u.line, lower(trim(u.kind)) AS kind, u.ord FROM (SELECT repo, path, language, unnest(refs) AS u FROM f))
"""

_IS_TEST = r"(contains(lower(path), '/tests/') OR contains(lower(path), '/__tests__/') OR regexp_matches(lower(path), '(^|/)test_[^/]*$') OR regexp_matches(lower(path), '_test\.py$') OR regexp_matches(lower(path), '\.(test|spec)\.[^/]*$'))"

_RESOLVE = r"""
, a AS (SELECT DISTINCT repo, path, language, target_name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') || '/' ELSE '' END AS pre,
    trim(target_name) AS nm FROM r WHERE target_file IS NULL AND target_name IS NOT NULL
), rel AS (
  SELECT *, length(regexp_extract(nm, '^[.]+')) AS dots, replace(regexp_replace(nm, '^[.]+', ''), '.', '/') AS rest FROM a WHERE language = 'python' AND starts_with(nm, '.')
), relb AS (SELECT *, repeat('../', (dots - 1)::INT) AS ups FROM rel
), c0 AS (
  SELECT a.*, k.pos, CASE k.pos WHEN 0 THEN pre || regexp_extract(nm, '[^.]*$') || '.py' WHEN 1 THEN replace(nm, '.', '/') || '.py' WHEN 2 THEN replace(nm, '.', '/') || '/__init__.py'
    ELSE pre || regexp_extract(nm, '[^.]*$') || '/__init__.py' END AS cand FROM a, (VALUES (0), (1), (2), (3)) k(pos) WHERE language = 'python' AND NOT starts_with(nm, '.')
  UNION ALL
  SELECT repo, path, language, target_name, pre, nm, k.pos, CASE WHEN rest = '' THEN pre || ups || '__init__.py' WHEN k.pos = 0 THEN pre || ups || rest || '.py' ELSE pre || ups || rest || '/__init__.py' END
  FROM relb, (VALUES (0), (1)) k(pos)
  UNION ALL
  SELECT a.*, k.pos, pre || target_name || k.e FROM a, (VALUES (0, '.ts'), (1, '.tsx'), (2, '.js'), (3, '.jsx'), (4, '/index.ts'), (5, '/index.js')) k(pos, e)
  WHERE language IN ('typescript', 'javascript') AND starts_with(target_name, '.')
  UNION ALL
  SELECT a.*, k.pos, 'src/' || array_to_string(CASE WHEN len(string_split(target_name[8:], '::')) > 1 THEN string_split(target_name[8:], '::')[:-2] ELSE string_split(target_name[8:], '::') END, '/') || k.e
  FROM a, (VALUES (0, '.rs'), (1, '/mod.rs')) k(pos, e) WHERE language = 'rust' AND starts_with(target_name, 'crate::')
  UNION ALL
  SELECT a.*, k.pos, pre || '../' || string_split(target_name[8:], '::')[1] || k.e FROM a, (VALUES (0, '.rs'), (1, '/mod.rs')) k(pos, e) WHERE language = 'rust' AND starts_with(target_name, 'super::')
  UNION ALL
  SELECT a.*, 0, replace(target_name, '.', '/') || '.java' FROM a WHERE language = 'java'
), n0 AS (SELECT DISTINCT cand AS raw, regexp_replace(regexp_replace('/' || cand, '/(\./)+', '/', 'g'), '/+', '/', 'g') AS p FROM c0
), n1 AS (SELECT raw, p FROM n0 UNION ALL SELECT raw, regexp_replace(p, '/[^/]+/\.\./', '/') FROM n1 WHERE regexp_matches(p, '/[^/.][^/]*/\.\./')
), n AS (SELECT raw, min_by(p, length(p))[2:] AS cand FROM n1 GROUP BY raw
), h1 AS (SELECT c.repo, c.path, c.language, c.target_name, min_by(n.cand, c.pos) AS target FROM c0 c JOIN n ON n.raw = c.cand JOIN f ON f.repo = c.repo AND f.path = n.cand GROUP BY ALL
), a2 AS (SELECT a.* FROM a ANTI JOIN h1 USING (repo, path, target_name)
), h2 AS (
  SELECT a2.repo, a2.path, a2.language, a2.target_name, coalesce(min(CASE WHEN contains(target_name, '.') AND contains(f.path, replace(regexp_replace(target_name, '[.][^.]*$', ''), '.', '/')) THEN f.path END), min(f.path)) AS target
  FROM a2 JOIN f ON f.repo = a2.repo AND (f.path = regexp_extract(target_name, '[^.]*$') || '.java' OR ends_with(f.path, '/' || regexp_extract(target_name, '[^.]*$') || '.java')) WHERE a2.language = 'java' GROUP BY ALL
), a3 AS (SELECT a2.* FROM a2 ANTI JOIN h2 USING (repo, path, target_name)
), fd AS (SELECT repo, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS top FROM f
), h3 AS (
  SELECT a3.repo, a3.path, a3.language, a3.target_name, fd.path AS target FROM a3 JOIN fd ON fd.repo = a3.repo WHERE a3.language = 'go'
    AND (fd.dir = target_name OR ends_with(fd.dir, '/' || target_name) AND NOT EXISTS (SELECT 1 FROM fd x WHERE x.repo = a3.repo AND x.dir = a3.target_name))
  UNION ALL
  SELECT a3.repo, a3.path, a3.language, a3.target_name, fd.path FROM a3 JOIN fd ON fd.repo = a3.repo WHERE a3.language = 'java' AND ends_with(target_name, '.*')
    AND starts_with(fd.path, replace(target_name[:-3], '.', '/') || '/') AND ends_with(fd.path, '.java')
), a4 AS (
  SELECT a3.*, CASE WHEN language = 'rust' THEN string_split(target_name, '::')[-1] WHEN language IN ('python', 'java') THEN regexp_extract(nm, '[^.]*$') ELSE target_name END AS lookup
  FROM a3 ANTI JOIN h3 USING (repo, path, target_name) WHERE language NOT IN ('typescript', 'javascript', 'go') AND NOT (language = 'python' AND starts_with(nm, '.'))
), cc AS (
  SELECT a4.repo, a4.path, a4.language, a4.target_name, s.path AS target,
    count(*) OVER k AS n_all, sum((g.dir = o.dir AND a4.language <> 'java')::INT) OVER k AS n_dir, sum((g.top = o.top AND a4.language <> 'java')::INT) OVER k AS n_top, g.dir = o.dir AS same_dir, g.top = o.top AS same_top
  FROM a4 JOIN s ON s.repo = a4.repo AND s.name = a4.lookup AND (s.path <> a4.path OR a4.language = 'java')
    JOIN fd g ON g.repo = s.repo AND g.path = s.path JOIN fd o ON o.repo = a4.repo AND o.path = a4.path
  WINDOW k AS (PARTITION BY a4.repo, a4.path, a4.target_name)
), h4 AS (SELECT repo, path, language, target_name, target, n_all = 1 OR n_dir = 1 OR n_top = 1 AS single FROM cc WHERE n_all = 1 OR (n_dir = 1 AND same_dir) OR (n_dir <> 1 AND n_top = 1 AND same_top) OR (n_all > 1 AND n_dir <> 1 AND n_top <> 1)
), res AS (
  SELECT *, 'path' AS how FROM h1 UNION ALL SELECT *, 'class' FROM h2 UNION ALL SELECT *, 'folder' FROM h3 UNION ALL SELECT repo, path, language, target_name, target, CASE WHEN single THEN 'symbol' ELSE 'ambiguous' END FROM h4)
"""

_TESTS = r"""
, tn AS (SELECT repo, path, language, regexp_extract(path, '[^/]*$') AS b, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', '') AS st FROM f
), tt AS (
  SELECT repo, path, language, CASE WHEN language = 'python' AND starts_with(st, 'test_') THEN st[6:] WHEN language IN ('python', 'go') AND ends_with(st, '_test') THEN st[:-6]
    WHEN language IN ('typescript', 'javascript') AND (contains(b, '.test.') OR contains(b, '.spec.') OR contains('/' || path, '/__tests__/')) THEN regexp_replace(regexp_replace(st, '\.test$', ''), '\.spec$', '')
    WHEN language = 'java' AND ends_with(st, 'Test') THEN st[:-5] END AS stem FROM tn
), dl AS (SELECT repo, path, string_split(path, '/')[:-2] AS d FROM f
), te AS (
  SELECT tt.repo, tt.path AS src, tt.stem, arg_min(x.path, (len(da.d) + len(db.d) - 2 * len(list_filter(range(1, 1 + least(len(da.d), len(db.d))), lambda i: da.d[1:i] = db.d[1:i])), x.path)) AS dst
  FROM tt JOIN tn x ON x.repo = tt.repo AND x.st = tt.stem AND x.path <> tt.path AND regexp_extract(x.path, '\.[^.]+$') IN (SELECT unnest(CASE tt.language WHEN 'python' THEN ['.py'] WHEN 'typescript' THEN ['.ts', '.tsx']
    WHEN 'javascript' THEN ['.js', '.jsx'] WHEN 'go' THEN ['.go'] ELSE ['.java'] END))
  JOIN dl da ON da.repo = tt.repo AND da.path = tt.path JOIN dl db ON db.repo = x.repo AND db.path = x.path GROUP BY ALL)
"""

_EDGES = (
    _RESOLVE
    + _TESTS
    + r"""
, lk AS (
  SELECT r.repo, r.path AS src, res.target AS dst, r.kind, r.target_name AS symbol, r.ord FROM r JOIN res ON res.repo = r.repo AND res.path = r.path AND res.target_name = r.target_name WHERE r.target_file IS NULL
  UNION ALL SELECT repo, path, target_file, kind, target_name, ord FROM r WHERE target_file IS NOT NULL
  UNION ALL SELECT repo, src, dst, 'tests', 'test:' || stem, 0 FROM te
), l1 AS (SELECT repo, src, dst, kind, symbol, min(ord) AS ord FROM lk WHERE src <> dst GROUP BY ALL
), e AS (SELECT repo, src, dst, kind, list(symbol ORDER BY ord, symbol) AS symbols FROM l1 GROUP BY ALL
), w AS (
  SELECT repo, src, dst, sum(CASE kind WHEN 'tests' THEN 1.25 WHEN 'imports' THEN 1.0 WHEN 'calls' THEN 0.9 WHEN 'uses_type' THEN 0.8 WHEN 'inherits' THEN 0.75 WHEN 'implements' THEN 0.75 ELSE 1.0 END::DOUBLE) AS weight
  FROM e GROUP BY ALL
), nd AS (SELECT repo, path FROM f UNION SELECT repo, src FROM e UNION SELECT repo, dst FROM e
), nb AS (SELECT repo, src AS path, dst AS other FROM e UNION SELECT repo, dst, src FROM e)
"""
)


@_query
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.stats(files(spark, d, "language", "symbols", "refs"))


SQL["language_stats"] = BASE + "SELECT repo, language, count(*) AS n_files, sum(len(symbols))::BIGINT AS n_symbols, sum(len(refs))::BIGINT AS n_refs FROM f GROUP BY repo, language"


@_query
def content_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sentinels, hash and line count from the bytes, as an index run computes them."""
    from ..sources.scan import describe

    return describe(table(spark, d, "files").select("repo", "path", "content")).distinct()


SQL["content_scan"] = r"""
WITH x AS (SELECT DISTINCT repo, path, content, contains(hex(content[1:8192]), '00') AND list_contains(list_transform(range(0, least(octet_length(content), 8192)), lambda i: hex(content)[2*i+1:2*i+2]), '00') AS nul,
  try(decode(content)) AS txt FROM files)
SELECT repo, path, CASE WHEN nul THEN 'binary' WHEN txt IS NULL THEN 'unknown' ELSE CASE regexp_extract(lower(path), '[^/]+(\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python'
  WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.java' THEN 'java' ELSE 'javascript' END END AS language,
  CASE WHEN nul OR txt IS NULL THEN '' ELSE sha256(content) END AS content_hash,
  CASE WHEN nul OR txt IS NULL OR txt = '' THEN 0 ELSE length(txt) - length(replace(txt, chr(10), '')) + (NOT ends_with(txt, chr(10)))::INT END::INT AS lines FROM x
"""


@_query
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Unchanged, changed or new, and gone files of the latest listing against the snapshot."""
    from ..sources.snapshot import diff, listing

    return diff(listing(table(spark, d, "file_scans")), files(spark, d, "content_hash"))


SQL["snapshot_diff"] = r"""
WITH RECURSIVE sp AS (SELECT DISTINCT path AS raw, regexp_replace(regexp_replace('/' || replace(path, chr(92), '/') || '/', '/(\./)+', '/', 'g'), '/+', '/', 'g') AS p FROM file_scans
), fo AS (SELECT raw, p FROM sp UNION ALL SELECT raw, regexp_replace(p, '/[^/]+/\.\./', '/') FROM fo WHERE regexp_matches(p, '/[^/]+/\.\./')
), no AS (SELECT raw, trim(min_by(p, length(p)), '/') AS path FROM fo GROUP BY raw
), ls AS (SELECT s.repo, n.path, max_by(struct_pack(h := lower(s.content_hash), g := s.is_deleted), (s.seen_at, s.scan_id)) AS l FROM file_scans s JOIN no n ON n.raw = s.path GROUP BY ALL
), cur AS (SELECT repo, path, l.h AS h FROM ls WHERE NOT l.g
), snap AS (SELECT DISTINCT ON (repo, path) repo, path, lower(coalesce(content_hash, '')) AS h FROM files ORDER BY repo, path, indexed_at DESC, run_id DESC)
SELECT coalesce(c.repo, s.repo) AS repo, coalesce(c.path, s.path) AS path, CASE WHEN c.path IS NULL THEN 'stale' WHEN s.path IS NOT NULL AND s.h = c.h THEN 'hit' ELSE 'miss' END AS state
FROM cur c FULL JOIN snap s ON s.repo = c.repo AND s.path = c.path
"""


@_query
def snapshot_store(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot written, its test files replaced by rows without lines, the first file of all removed, and what is then read back."""
    from ..session import scratch_dir
    from ..sources.snapshot import Snapshot

    f = indexed(spark, d)
    with Snapshot(spark, scratch_dir(spark, "snapshot")) as s:
        s.write(f)
        s.put(f.filter(F.expr(t.is_test_path("path"))).withColumn("lines", F.lit(0)))
        first = s.get_all().orderBy("path", "repo").first()
        if first:
            s.invalidate(first["path"], first["repo"])
        return s.get_all().select("repo", "path", "language", "content_hash", "lines", F.size("symbols").alias("n_symbols"), F.size("refs").alias("n_refs"))


SQL["snapshot_store"] = BASE.replace("path, content,", "path, content, coalesce(content_hash, '') AS content_hash, coalesce(lines, 0) AS lines,", 1) + """
SELECT repo, path, coalesce(language, 'unknown') AS language, content_hash, CASE WHEN _TEST_ THEN 0 ELSE lines END AS lines, len(symbols)::INT AS n_symbols, len(refs)::INT AS n_refs FROM f
WHERE (path, repo) <> (SELECT (path, repo) FROM f ORDER BY path, repo LIMIT 1)
""".replace("_TEST_", _IS_TEST)


@_query
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How often each token stands in symbol names, and in how many distinct names."""
    names = index.symbols_of(files(spark, d, "symbols")).select("name", F.explode(F.expr(t.tokenize("name"))).alias("token"))
    return names.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"))


SQL["name_tokens"] = BASE + r"""
, raw AS (SELECT name, unnest(regexp_extract_all(name, '[A-Za-z0-9_]+')) AS w FROM s
), tok AS (
  SELECT name, lower(w) AS token FROM raw
  UNION ALL SELECT name, lower(p) FROM (SELECT name, unnest(string_split(w, '_')) AS p FROM raw WHERE contains(w, '_')) WHERE p <> ''
  UNION ALL SELECT name, lower(p) FROM (SELECT name, w, unnest(string_split(regexp_replace(w, '([A-Z])', chr(1) || '\1', 'g'), chr(1))) AS p FROM raw WHERE regexp_matches(w[2:], '[A-Z]')) WHERE p <> '' AND p <> w)
SELECT token, count(*) AS n, count(DISTINCT name) AS n_names FROM tok GROUP BY token
"""


@_query
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Stem, compact form, test flag and folder of every path."""
    p = files(spark, d, "language").select("repo", "path")
    return p.select("repo", "path", F.expr(t.stem("path")).alias("stem"), F.expr(t.compact("path")).alias("compact_path"), F.expr(t.is_test_path("path")).alias("is_test"), F.expr(t.dirname("path")).alias("folder"))


SQL["path_parts"] = BASE + r"""
SELECT repo, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem, lower(regexp_replace(path, '[^A-Za-z0-9]', '', 'g')) AS compact_path,
  contains(lower(path), '/tests/') OR contains(lower(path), '/__tests__/') OR regexp_matches(lower(path), '(^|/)test_[^/]*$') OR regexp_matches(lower(path), '_test\.py$') OR regexp_matches(lower(path), '\.(test|spec)\.[^/]*$') AS is_test,
  CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM f
"""


@_query
def method_dedup(spark: SparkSession, d: str) -> DataFrame:
    return index.drop_functions_of_methods(index.symbols_of(files(spark, d, "symbols"))).select("repo", "path", "name", "kind", "line", "ord")


SQL["method_dedup"] = BASE + """
, z AS (SELECT repo, path, name, kind, line, ord FROM s)
SELECT * FROM z WHERE NOT (kind = 'function' AND EXISTS (SELECT 1 FROM z m WHERE m.repo = z.repo AND m.path = z.path AND m.line = z.line AND m.kind = 'method'))
"""


@_query
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up by the collision rule alone, for all asks of every language."""
    f = materialize(files(spark, d, "language", "symbols", "refs"), "files")
    asks = resolve.asks_of(index.references_of(f)).withColumn("language", F.lit("any"))
    return resolve.by_symbol(asks, index.symbols_of(f)).select("repo", "path", "target_name", "n_targets", "target")


SQL["symbol_lookup"] = BASE + r"""
, a AS (SELECT DISTINCT repo, path, target_name FROM r WHERE target_file IS NULL AND target_name IS NOT NULL
), g AS (SELECT repo, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS top FROM f
), c AS (SELECT a.*, s.path AS cand, x.dir = y.dir AS sd, x.top = y.top AS st FROM a JOIN s ON s.repo = a.repo AND s.name = a.target_name AND s.path <> a.path JOIN g x ON x.repo = a.repo AND x.path = a.path JOIN g y ON y.repo = s.repo AND y.path = s.path
), k AS (SELECT repo, path, target_name, count(*) AS n, count(*) FILTER (sd) AS nd, count(*) FILTER (st) AS nt, min(cand) AS c1, min(cand) FILTER (sd) AS cd, min(cand) FILTER (st) AS ct FROM c GROUP BY ALL)
SELECT repo, path, target_name, CASE WHEN n = 1 OR nd = 1 OR nt = 1 THEN 1 ELSE n END AS n_targets, CASE WHEN n = 1 THEN c1 WHEN nd = 1 THEN cd WHEN nt = 1 THEN ct END AS target FROM k
"""


@_query
def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    f = materialize(files(spark, d, "language", "symbols", "refs"), "files")
    refs, symbols = index.references_of(f), index.symbols_of(f)
    return resolve.resolve(f, refs, symbols).select("repo", "path", "target_name", "how", "n_targets", "target")


SQL["reference_resolution"] = BASE + _RESOLVE + "SELECT repo, path, target_name, how, count(*) AS n_targets, CASE WHEN how <> 'ambiguous' THEN min(target) END AS target FROM res GROUP BY repo, path, target_name, how"


@_query
def test_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.test_edges(indexed(spark, d, "language"))


SQL["test_edges"] = BASE + _TESTS + "SELECT repo, src, dst, stem FROM te WHERE src <> dst"


@_query
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return factored.edges(parts(spark, d))


SQL["edge_merge"] = BASE + _EDGES + "SELECT repo, src, dst, kind, symbols FROM e"


@_query
def weighted_digraph(spark: SparkSession, d: str) -> DataFrame:
    return factored.weights(parts(spark, d)).select("repo", "src", "dst", F.round("weight", 6).alias("weight"), F.round("out_weight", 6).alias("out_weight"))


SQL["weighted_digraph"] = BASE + _EDGES + "SELECT repo, src, dst, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY repo, src), 6) AS out_weight FROM w"


def _steps(start: str) -> str:
    """SQL of the iteration to its end from the start vector ``p0(repo, path, p)``: ``xk(repo, path, x)``.

    The recursive part drops a repository once its last change is below its nodes times the tolerance.
    """
    return f""", p0 AS ({start}), ow AS (SELECT repo, src, sum(weight) AS o FROM w GROUP BY ALL)
, it AS (
  SELECT 0 AS k, p0.repo, p0.path, p0.p, ow.o, p0.p AS x, 1e9::DOUBLE AS delta FROM p0 LEFT JOIN ow ON ow.repo = p0.repo AND ow.src = p0.path
  UNION ALL
  SELECT any_value(k) + 1, repo, path, max(p), max(o), sum(y), abs(sum(y) - max(x)) FROM (
    SELECT m.k, m.repo, m.path, m.p, m.o, m.x, 0.15 * m.p + 0.85 * m.lost * m.p AS y FROM (
      SELECT *, sum(CASE WHEN o IS NULL THEN x ELSE 0 END) OVER (PARTITION BY repo) AS lost, sum(delta) OVER (PARTITION BY repo) AS moved, count(*) OVER (PARTITION BY repo) AS n FROM it) m WHERE m.moved >= m.n * 1e-6 AND m.k < 100
    UNION ALL
    SELECT m.k, m.repo, w.dst, NULL, NULL, NULL, 0.85 * m.x * w.weight / m.o FROM (
      SELECT *, sum(delta) OVER (PARTITION BY repo) AS moved, count(*) OVER (PARTITION BY repo) AS n FROM it) m JOIN w ON w.repo = m.repo AND w.src = m.path WHERE m.moved >= m.n * 1e-6 AND m.k < 100
  ) GROUP BY repo, path
), xk AS (SELECT repo, path, arg_max(x, k) AS x FROM it GROUP BY repo, path)
"""


_SCORES = "SELECT repo, path, round(x / sum(x) OVER (PARTITION BY repo), 6) AS score FROM xk"


def _pagerank(spark: SparkSession, d: str, loop: bool = False, personal: bool = False) -> DataFrame:
    got = factored.scores(parts(spark, d, _TEST_FILE if personal else "0.0D", loop=loop), personal)
    return got.select("repo", "path", F.round("score", 6).alias("score"))


@_query
def pagerank_global(spark: SparkSession, d: str) -> DataFrame:
    return _pagerank(spark, d)


SQL["pagerank_global"] = BASE + _EDGES + _steps("SELECT repo, path, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo) AS p FROM nd") + _SCORES


@_query
def pagerank_distributed(spark: SparkSession, d: str) -> DataFrame:
    """The same by the loop for graphs too large for one task, which most of these are not."""
    return _pagerank(spark, d, loop=True)


SQL["pagerank_distributed"] = SQL["pagerank_global"]


@_query
def pagerank_personalized(spark: SparkSession, d: str) -> DataFrame:
    """Personalized by test files: each counts 1."""
    return _pagerank(spark, d, personal=True)


SQL["pagerank_personalized"] = BASE + _EDGES + _steps(
    f"SELECT repo, path, CASE WHEN sum({_IS_TEST}::INT) OVER (PARTITION BY repo) > 0 THEN {_IS_TEST}::INT::DOUBLE / sum({_IS_TEST}::INT) OVER (PARTITION BY repo) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY repo) END AS p FROM nd"
) + _SCORES


@_query
def seed_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Relevance spread from test files over two hops."""
    got = factored.scores(parts(spark, d, _TEST_FILE), near=True, rank=False)
    return got.filter("known or near > 0").select("repo", "path", F.round("near", 6).alias("score"))


SQL["seed_expansion"] = BASE + _EDGES + f"""
, h0 AS (SELECT repo, path, {_IS_TEST}::INT::DOUBLE AS score FROM f)
, h1x AS (SELECT nb.repo, nb.other AS path, max(0.6 * score) AS score FROM h0 JOIN nb ON nb.repo = h0.repo AND nb.path = h0.path WHERE score > 0 GROUP BY ALL)
, h2x AS (SELECT nb.repo, nb.other AS path, max(0.6 * score) AS score FROM h1x JOIN nb ON nb.repo = h1x.repo AND nb.path = h1x.path GROUP BY ALL)
SELECT repo, path, round(max(score), 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1x UNION ALL SELECT * FROM h2x) GROUP BY repo, path
"""


@_query
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return lexical.lexical(files(spark, d, "symbols"), QUERY)


# The same score by rows: one row per (file, word), and per (file, word, symbol) for the symbols' part.
_LEXICAL = r"""
, kw AS (SELECT unnest(['parse', 'invoice', 'handler']) AS k
), q AS (SELECT ['parse', 'invoice', 'handler'] AS ks, 'parseinvoicehandler' AS cq
), tokr AS (SELECT 'p' AS src, repo, path, 0 AS id, 0 AS pos, path AS txt FROM f UNION ALL SELECT 't', repo, path, 0, 0, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')) FROM f
  UNION ALL SELECT 's', repo, path, ord, 0, name FROM s WHERE name IS NOT NULL
), tokw AS (SELECT src, repo, path, id, generate_subscripts(regexp_extract_all(txt, '[A-Za-z0-9_]+'), 1) AS i, unnest(regexp_extract_all(txt, '[A-Za-z0-9_]+')) AS w FROM tokr
), toks AS (
  SELECT src, repo, path, id, flatten(list(list_concat([lower(w)], CASE WHEN contains(w, '_') THEN list_transform(list_filter(string_split(w, '_'), lambda y: y <> ''), lambda y: lower(y)) ELSE []::VARCHAR[] END,
    CASE WHEN regexp_matches(w[2:], '[A-Z]') THEN list_transform(list_filter(string_split(regexp_replace(w, '([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda y: y <> '' AND y <> w), lambda y: lower(y)) ELSE []::VARCHAR[] END) ORDER BY i)) AS ts
  FROM tokw GROUP BY ALL
), io AS (
  SELECT *, {ordered} AS ordered FROM toks
), fb AS (
  SELECT f.repo, f.path, lower(regexp_extract(f.path, '[^/]*$')) AS base, lower(regexp_replace(regexp_extract(f.path, '[^/]*$'), '\.[^.]*$', '')) AS stem, lower(f.path) AS lp,
    coalesce(p.ts, []) AS pt, coalesce(t.ts, []) AS st, coalesce(t.ordered, false) AS sto FROM f LEFT JOIN io p ON p.src = 'p' AND p.repo = f.repo AND p.path = f.path LEFT JOIN io t ON t.src = 't' AND t.repo = f.repo AND t.path = f.path
), sy AS (
  SELECT s.repo, s.path, k, max(greatest(CASE WHEN lower(name) = k THEN 12.0 WHEN list_contains(coalesce(ts, []), k) THEN 7.0 WHEN contains(lower(name), k) THEN 4.5 ELSE 0 END, CASE WHEN contains(lower(signature), k) THEN 1.5 ELSE 0 END,
    CASE WHEN lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) = cq THEN 22.0 WHEN contains(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), cq) THEN 14.0 ELSE 0 END,
    CASE WHEN ts = ks THEN 18.0 WHEN ordered THEN 10.0 ELSE 0 END)) AS b
  FROM s CROSS JOIN kw CROSS JOIN q LEFT JOIN io ON io.src = 's' AND io.repo = s.repo AND io.path = s.path AND io.id = s.ord GROUP BY ALL
), pk AS (
  SELECT fb.repo, fb.path, kw.k, greatest(CASE WHEN base = kw.k THEN 8.0 ELSE 0 END, CASE WHEN stem = kw.k THEN 9.0 WHEN contains(base, kw.k) THEN 5.0 ELSE 0 END, CASE WHEN list_contains(pt, kw.k) THEN 4.0 WHEN contains(lp, kw.k) THEN 2.5 ELSE 0 END, coalesce(sy.b, 0)) AS b
  FROM fb CROSS JOIN kw LEFT JOIN sy ON sy.repo = fb.repo AND sy.path = fb.path AND sy.k = kw.k
), shp AS (
  SELECT repo, path, CASE WHEN regexp_replace(stem, '[^a-z0-9]', '', 'g') = cq THEN 28.0 WHEN contains(regexp_replace(stem, '[^a-z0-9]', '', 'g'), cq) THEN 18.0 WHEN contains(regexp_replace(lp, '[^a-z0-9]', '', 'g'), cq) THEN 12.0 ELSE 0 END
    + CASE WHEN st = ks THEN 24.0 WHEN sto THEN 14.0 ELSE 0 END
    + CASE WHEN stem IN ('parse invoice handler', 'parse_invoice_handler', 'parse-invoice-handler', 'parse/invoice/handler') THEN 26.0
      WHEN contains(base, 'parse invoice handler') OR contains(base, 'parse_invoice_handler') OR contains(base, 'parse-invoice-handler') THEN 16.0 ELSE 0 END AS v FROM fb CROSS JOIN q
), lx AS (
  SELECT pk.repo, pk.path, (shp.v + sum(b) + 1.5 * count(*) FILTER (b > 0) + CASE WHEN count(*) FILTER (b > 0) = 3 THEN 6.0 ELSE 0 END)::DOUBLE AS lexical FROM pk JOIN shp USING (repo, path) GROUP BY pk.repo, pk.path, shp.v)
"""


def _lexical_for(query: str) -> str:
    """The SQL of the lexical score for a query of any words."""
    words = query.split()

    def follow(ts: str, rest: list[str]) -> str:
        after = f"list_slice({ts}, list_position({ts}, '{rest[0]}') + 1, len({ts}))"
        return f"list_contains({ts}, '{rest[0]}')" + (f" AND {follow(after, rest[1:])}" if rest[1:] else "")

    sql = _LEXICAL.replace("{ordered}", follow("ts", words)).replace("['parse', 'invoice', 'handler']", str(words)).replace("(b > 0) = 3", f"(b > 0) = {len(words)}")
    for joint in ("", " ", "_", "-", "/"):
        sql = sql.replace(joint.join(QUERY.split()), joint.join(words))
    return sql


SQL["lexical_score"] = BASE + _lexical_for(QUERY) + "SELECT repo, path, lexical FROM lx"


def _for_query(spark: SparkSession, d: str, query: str) -> tuple[DataFrame, DataFrame]:
    """The parts, and the hybrid rank of all nodes for a query: ``repo, path, known, score``."""
    words = lexical.words_of(query)
    p = parts(spark, d, lexical.lexical_score(words))
    return p, factored.scores(p, personal=True, near=True).select("repo", "path", "known", rank.query_score(words).alias("score"))


def _around_tests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The parts, and the rank around each repository's first test file by path: ``repo, path, known, value, top_value, score``."""
    p = parts(spark, d, _TEST_FILE, first=True)
    return p, factored.scores(p, personal=True, near=True).select("repo", "path", "known", "value", "top_value", rank.files_score().alias("score"))


@_query
def rank_query(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid rank of all files for a query."""
    return _for_query(spark, d, QUERY)[1].select("repo", "path", F.round("score", 4).alias("score"))


@_query
def rank_test_query(spark: SparkSession, d: str) -> DataFrame:
    """The same for a query that asks for tests, whose paths are not damped then."""
    return _for_query(spark, d, TEST_QUERY)[1].select("repo", "path", F.round("score", 4).alias("score"))


@_query
def rank_files(spark: SparkSession, d: str) -> DataFrame:
    """Ranked around each repository's first test file by path."""
    return _around_tests(spark, d)[1].select("repo", "path", F.round("score", 4).alias("score"))


def _hybrid(seed: str, start: str, mix: tuple, damp: str) -> str:
    """SQL of a hybrid rank ``rk(repo, path, score)``; ``seed`` selects ``repo, path, v`` of all nodes."""
    return _steps(start) + f"""
, sd AS ({seed}), mx AS (SELECT repo, max(v) AS m FROM sd GROUP BY repo)
, sn AS (SELECT sd.repo, sd.path, CASE WHEN m > 0 THEN v / m ELSE 0 END::DOUBLE AS v FROM sd JOIN mx USING (repo))
, s1 AS (SELECT nb.repo, nb.other AS path, max(0.6::DOUBLE * v) AS v FROM sn JOIN nb ON nb.repo = sn.repo AND nb.path = sn.path WHERE v > 0 GROUP BY ALL)
, s2 AS (SELECT nb.repo, nb.other AS path, max(0.6::DOUBLE * v) AS v FROM s1 JOIN nb ON nb.repo = s1.repo AND nb.path = s1.path GROUP BY ALL)
, sx AS (SELECT repo, path, max(v) AS v FROM (SELECT * FROM sn UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY ALL)
, pr AS (SELECT repo, path, x / sum(x) OVER (PARTITION BY repo) AS v FROM xk)
, rk AS (SELECT sn.repo, sn.path, CASE WHEN mx.m > 0 THEN ({mix[0]} * sn.v + {mix[1]} * sx.v / nullif(max(sx.v) OVER k, 0) + {mix[2]} * pr.v / max(pr.v) OVER k) * {damp} ELSE pr.v END AS score
FROM sn JOIN mx USING (repo) JOIN sx ON sx.repo = sn.repo AND sx.path = sn.path JOIN pr ON pr.repo = sn.repo AND pr.path = sn.path WINDOW k AS (PARTITION BY sn.repo))
"""


_LX = "SELECT nd.repo, nd.path, coalesce(lexical, 0)::DOUBLE AS v FROM nd LEFT JOIN lx ON lx.repo = nd.repo AND lx.path = nd.path"
_FROM_LX = f"SELECT repo, path, CASE WHEN sum(v) OVER k > 0 THEN v / sum(v) OVER k ELSE 1.0::DOUBLE / count(*) OVER k END AS p FROM ({_LX}) WINDOW k AS (PARTITION BY repo)"
_DAMP = f"CASE WHEN {_IS_TEST.replace('path', 'sn.path')} THEN 0.6 ELSE 1.0 END"
_RANKS = "SELECT repo, path, round(score, 4) AS score FROM rk"
_QUERY_RANKS = _lexical_for(QUERY) + _hybrid(_LX, _FROM_LX, rank.QUERY_MIX, _DAMP)
SQL["rank_query"] = BASE + _EDGES + _QUERY_RANKS + _RANKS
SQL["rank_test_query"] = BASE + _EDGES + _lexical_for(TEST_QUERY) + _hybrid(_LX, _FROM_LX, rank.QUERY_MIX, "1.0") + _RANKS
_SD = f"SELECT nd.repo, nd.path, (nd.path = (SELECT min(path) FROM f WHERE f.repo = nd.repo AND {_IS_TEST}))::INT::DOUBLE AS v0 FROM nd"
_SD = f"SELECT repo, path, coalesce(v0, 0) AS v FROM ({_SD})"
_FILE_RANKS = _hybrid(
    _SD, f"SELECT repo, path, CASE WHEN sum(v) OVER k > 0 THEN v / sum(v) OVER k ELSE 1.0::DOUBLE / count(*) OVER k END AS p FROM ({_SD}) WINDOW k AS (PARTITION BY repo)", rank.FILES_MIX, "1.0"
)
SQL["rank_files"] = BASE + _EDGES + _FILE_RANKS + _RANKS


_GLOBAL = _steps("SELECT repo, path, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo) AS p FROM nd")
# Files by PageRank, with their tier and what is printed of them.
_PLACED = r"""
, o AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY round(x / total, 12) DESC, path)::INT AS rank, n FROM (SELECT *, sum(x) OVER (PARTITION BY repo) AS total, count(*) OVER (PARTITION BY repo) AS n FROM xk)
), o2 AS (
  SELECT o.*, coalesce(f.symbols, []) AS symbols, f.language, CASE WHEN rank <= greatest(1, ceil(n * 0.3::DOUBLE)) THEN 1 WHEN rank <= greatest(1, ceil(n * 0.6::DOUBLE)) THEN 2 WHEN rank <= greatest(1, ceil(n * 0.8::DOUBLE)) THEN 3 ELSE 4 END::INT AS tier,
    CASE WHEN len(f.symbols) > 0 THEN 'Defines: ' || array_to_string(list_transform(f.symbols[1:5], lambda x: x.name), ', ') || CASE WHEN len(f.symbols) > 5 THEN ', ...' ELSE '' END END AS summary
  FROM o LEFT JOIN f ON f.repo = o.repo AND f.path = o.path)
"""


@_query
def tiers_summary(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by PageRank, with summaries."""
    tiers = rank.tiers(factored.scores(parts(spark, d)).select("repo", "path", "score"))
    s = files(spark, d, "symbols").select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.expr(lexical.summary()).alias("summary"))
    return tiers.join(s, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left").select("repo", "path", "rank", "tier", "summary")


SQL["tiers_summary"] = BASE + _EDGES + _GLOBAL + _PLACED + "SELECT repo, path, rank, tier, summary FROM o2"


@_query
def evidence_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The evidence symbols of every file that has any."""
    made = files(spark, d, "symbols").select("repo", "path", F.explode(F.expr(evidence.evidence_symbols(lexical.words_of(QUERY)))).alias("e"))
    return made.select("repo", "path", "e.name", "e.line", "e.score", "e.matched_terms", "e.reasons")


SQL["evidence_symbols"] = BASE + r"""
, kw AS (SELECT unnest(['parse', 'invoice', 'handler']) AS k, unnest([1, 2, 3]) AS ko
), w0 AS (SELECT repo, path, ord, z, name, signature, generate_subscripts(regexp_extract_all(x, '[A-Za-z0-9_]+'), 1) AS i, unnest(regexp_extract_all(x, '[A-Za-z0-9_]+')) AS w
  FROM (SELECT repo, path, ord, 'n' AS z, name, signature, name AS x FROM s UNION ALL SELECT repo, path, ord, 'a', name, signature, name || ' ' || signature FROM s)
), tk AS (
  SELECT repo, path, ord, z, flatten(list(list_concat([lower(w)], CASE WHEN contains(w, '_') THEN list_transform(list_filter(string_split(w, '_'), lambda y: y <> ''), lambda y: lower(y)) ELSE []::VARCHAR[] END,
    CASE WHEN regexp_matches(w[2:], '[A-Z]') THEN list_transform(list_filter(string_split(regexp_replace(w, '([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda y: y <> '' AND y <> w), lambda y: lower(y)) ELSE []::VARCHAR[] END) ORDER BY i)) AS ts FROM w0 GROUP BY repo, path, ord, z
), b AS (SELECT s.*, coalesce(n.ts, []) AS nt, coalesce(a.ts, []) AS att FROM s LEFT JOIN tk n ON n.z = 'n' AND n.repo = s.repo AND n.path = s.path AND n.ord = s.ord LEFT JOIN tk a ON a.z = 'a' AND a.repo = s.repo AND a.path = s.path AND a.ord = s.ord
), sc AS (
  SELECT repo, path, name, line, ord, parent, sum(CASE WHEN lower(name) = k THEN 10 WHEN list_contains(nt, k) THEN 6 WHEN contains(lower(name), k) THEN 4 WHEN contains(lower(signature), k) THEN 1 ELSE 0 END)
    + any_value(CASE WHEN lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) = 'parseinvoicehandler' THEN 22 WHEN contains(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')), 'parseinvoicehandler') THEN 12 ELSE 0 END)
    + any_value(CASE WHEN nt = ['parse', 'invoice', 'handler'] THEN 18 WHEN list_filter(nt, lambda y: y IN ('parse', 'invoice', 'handler')) = ['parse', 'invoice', 'handler'] THEN 10 ELSE 0 END) AS score,
    coalesce(list(k ORDER BY ko) FILTER (contains(lower(name || ' ' || signature), k) OR list_contains(att, k)), []) AS matched_terms FROM b CROSS JOIN kw GROUP BY ALL
), kp AS (SELECT *, max((score > 0 OR len(matched_terms) > 0)::INT) OVER (PARTITION BY repo, path) AS any_hit, row_number() OVER (PARTITION BY repo, path ORDER BY ord) AS first_n FROM sc
), pk AS (
  SELECT repo, path, name, line, CASE WHEN any_hit = 1 THEN score ELSE 0 END::DOUBLE AS score, CASE WHEN any_hit = 1 THEN matched_terms ELSE [] END AS matched_terms,
    CASE WHEN any_hit = 1 THEN list_concat(CASE WHEN len(matched_terms) > 0 THEN ['query-term-match'] ELSE [] END, CASE WHEN parent IS NOT NULL AND parent <> '' THEN ['member-of:' || parent] ELSE [] END,
      CASE WHEN score >= 18 THEN ['exact-symbol-shape'] WHEN score >= 8 THEN ['strong-symbol-match'] ELSE [] END) ELSE [] END AS reasons, ord
  FROM kp WHERE (any_hit = 1 AND (score > 0 OR len(matched_terms) > 0)) OR (any_hit = 0 AND first_n <= 5))
SELECT repo, path, name, line, score, matched_terms, reasons FROM pk QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY score DESC, line, lower(name), ord) <= 5
"""


@_query
def evidence_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return factored.neighbors(parts(spark, d))


SQL["evidence_neighbors"] = BASE + _EDGES + r"""
, b AS (SELECT repo, src AS path, dst AS other, 'outgoing' AS direction, kind, list_sort(list_distinct(symbols))[1:5] AS symbols FROM e UNION ALL SELECT repo, dst, src, 'incoming', kind, list_sort(list_distinct(symbols))[1:5] FROM e)
SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY len(symbols) DESC, lower(other), direction, kind, other)::INT AS k, other, direction, kind, symbols FROM b QUALIFY k <= 3
"""


def _evidence_sql(ranks: str, words: list[str], symbols: str) -> str:
    """SQL of evidence files ``ef``, the first 8 of each repository; ``symbols`` makes ``es(repo, path, name, line, end_line, matched_terms, rn)``."""
    ks, compact = f"{words}::VARCHAR[]", "".join(words)
    own = f"""CASE WHEN '{compact}' <> '' AND lower(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '[^A-Za-z0-9]', '', 'g')) = '{compact}' THEN ['exact-path-shape']
      WHEN {len(words)} > 1 AND sto THEN ['ordered-path-match'] ELSE [] END""" if words else "[]"
    return ranks + symbols + f"""
, tp AS (SELECT rk.repo, rk.path, rk.score, f.language, f.symbols, row_number() OVER (PARTITION BY rk.repo ORDER BY round(rk.score, 12) DESC, rk.path)::INT AS k FROM rk JOIN f ON f.repo = rk.repo AND f.path = rk.path QUALIFY k <= 8
), ebs AS (SELECT repo, src AS path, dst AS other, 'outgoing' AS direction, kind, list_sort(list_distinct(symbols))[1:5] AS symbols FROM e UNION ALL SELECT repo, dst, src, 'incoming', kind, list_sort(list_distinct(symbols))[1:5] FROM e
), enb AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY len(symbols) DESC, lower(other), direction, kind, other) AS nk FROM ebs QUALIFY nk <= 3
), ena AS (SELECT repo, path, list(other || ' ' || kind || ' ' || direction ORDER BY nk) AS neighbors FROM enb GROUP BY repo, path
), esa AS (SELECT repo, path, list(name ORDER BY rn) AS names, list_distinct(flatten(list(matched_terms))) AS terms, min(line) AS focus_start, max(coalesce(nullif(end_line, 0), line)) AS focus_end FROM es GROUP BY repo, path
), ef0 AS (
  SELECT tp.*, {'coalesce(fb.sto, false)' if words else 'false'} AS sto, list_filter({ks}, lambda y: contains(lower(tp.path), y){" OR list_contains(fb.pt, y)" if words else ""}) AS in_path, coalesce(esa.terms, []) AS terms, coalesce(esa.names, []) AS names, focus_start, focus_end, coalesce(ena.neighbors, []) AS neighbors
  FROM tp LEFT JOIN esa ON esa.repo = tp.repo AND esa.path = tp.path LEFT JOIN ena ON ena.repo = tp.repo AND ena.path = tp.path {"LEFT JOIN fb ON fb.repo = tp.repo AND fb.path = tp.path" if words else ""}
), ef1 AS (
  SELECT *, list_concat({"CASE WHEN path = (SELECT min(path) FROM f WHERE f.repo = ef0.repo AND " + _IS_TEST + ") THEN ['seed-file'] ELSE [] END" if not words else "[]"}, {own}, CASE WHEN len(in_path) > 0 AND len(in_path) = {len(set(words))} THEN ['full-path-keyword-cover'] ELSE [] END,
    CASE WHEN len(in_path) > 0 THEN ['path-match'] ELSE [] END, CASE WHEN len(terms) > 0 THEN ['symbol-match'] ELSE [] END, CASE WHEN len(neighbors) > 0 THEN ['graph-neighbor'] ELSE [] END) AS found FROM ef0
), ef AS (
  SELECT repo, k, path, round(score, 6) AS rank, language, CASE WHEN len(symbols) > 0 THEN 'Defines: ' || array_to_string(list_transform(symbols[1:5], lambda x: x.name), ', ') || CASE WHEN len(symbols) > 5 THEN ', ...' ELSE '' END END AS summary,
    list_sort(list_distinct(list_concat(in_path, terms)))::VARCHAR[] AS matched_terms, CASE WHEN len(found) = 0 AND len(symbols) > 0 THEN ['structural-rank'] ELSE found END::VARCHAR[] AS reasons, names::VARCHAR[] AS symbols, neighbors::VARCHAR[] AS neighbors, focus_start, focus_end FROM ef1)
"""


def _evidence_rows(packs: DataFrame) -> DataFrame:
    """The files of evidence packs as flat rows."""
    each = packs.select("repo", F.posexplode("files").alias("k", "f"))
    return each.select(
        "repo", (F.col("k") + 1).alias("k"), "f.path", "f.rank", "f.language", "f.summary", "f.matched_terms", "f.reasons", F.col("f.symbols.name").alias("symbols"),
        F.transform("f.neighbors", lambda n: F.concat_ws(" ", n["path"], n["kind"], n["direction"])).alias("neighbors"), F.col("f.focus_range.start").alias("focus_start"), F.col("f.focus_range.end").alias("focus_end"),
    )


def _query_packs(spark: SparkSession, d: str) -> DataFrame:
    p, ranks = _for_query(spark, d, QUERY)
    return evidence.query_packs(ranks.filter("known"), files(spark, d, "language", "symbols"), lambda top: factored.neighbors(p, only=top), QUERY)


def _file_packs(spark: SparkSession, d: str) -> DataFrame:
    p, ranks = _around_tests(spark, d)
    ranks = ranks.filter("known and top_value > 0")
    seeds = ranks.filter("value > 0").select("repo", "path")
    return evidence.file_packs(ranks, files(spark, d, "language", "symbols"), lambda top: factored.neighbors(p, only=top), seeds)


def _packed(packs: DataFrame, *columns: str) -> DataFrame:
    return packs.select("repo", "mode", "confidence", F.col("files.path").alias("paths"), *columns)


@_query
def evidence_query(spark: SparkSession, d: str) -> DataFrame:
    """The evidence packs of all repositories for a query: what is said of the pack as a whole."""
    return _packed(_query_packs(spark, d), "query", "matched_terms", "missed_terms")


@_query
def evidence_query_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the same packs."""
    return _evidence_rows(_query_packs(spark, d))


@_query
def evidence_files(spark: SparkSession, d: str) -> DataFrame:
    """The evidence packs around each repository's first test file by path."""
    return _packed(_file_packs(spark, d), "seed_files")


@_query
def evidence_seed_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the same packs."""
    return _evidence_rows(_file_packs(spark, d))


_QUERY_SYMBOLS = SQL["evidence_symbols"][len(BASE) :].rsplit("SELECT repo, path, name, line, score", 1)[0]
for _cte in ("kw", "w0", "tk", "b", "sc", "kp", "pk"):
    _QUERY_SYMBOLS = re.sub(rf"(?<![\w.']){_cte} AS (?=\()|(?<=FROM ){_cte}\b|(?<=JOIN ){_cte}\b", lambda m: m.group().replace(_cte, f"e_{_cte}", 1), _QUERY_SYMBOLS)  # noqa: B023
_QUERY_SYMBOLS += "\n, es AS (SELECT p.repo, p.path, p.name, p.line, s.end_line, p.matched_terms, row_number() OVER (PARTITION BY p.repo, p.path ORDER BY p.score DESC, p.line, lower(p.name), p.ord) AS rn FROM e_pk p JOIN s ON s.repo = p.repo AND s.path = p.path AND s.ord = p.ord QUALIFY rn <= 5)\n"
_FIRST_SYMBOLS = "\n, es AS (SELECT repo, path, name, line, end_line, []::VARCHAR[] AS matched_terms, row_number() OVER (PARTITION BY repo, path ORDER BY line, lower(name), ord) AS rn FROM s QUALIFY rn <= 5)\n"
_FLAT = "SELECT repo, k, path, rank, language, summary, matched_terms, reasons, symbols, neighbors, focus_start, focus_end FROM ef"
_OF_QUERY = BASE + _EDGES + _evidence_sql(_QUERY_RANKS, QUERY.split(), _QUERY_SYMBOLS)
_OF_SEEDS = BASE + _EDGES + _evidence_sql(_FILE_RANKS, [], _FIRST_SYMBOLS)
SQL["evidence_query_files"] = _OF_QUERY + _FLAT
SQL["evidence_seed_files"] = _OF_SEEDS + _FLAT + f" WHERE repo IN (SELECT repo FROM f WHERE {_IS_TEST})"
SQL["evidence_query"] = _OF_QUERY + f"""
, packs AS (
  SELECT repo, list(path ORDER BY k) AS paths, list_sort(list_distinct(flatten(list(matched_terms)))) AS matched_terms, max(rank) FILTER (k = 1) AS r1, coalesce(max(rank) FILTER (k = 2), 0) AS r2,
    len(list_distinct(flatten(list(matched_terms) FILTER (k <= 3)))) AS covered, flatten(list(reasons) FILTER (k = 1)) AS top FROM ef GROUP BY repo)
SELECT repo, 'query' AS mode, '{QUERY}' AS query, paths, matched_terms, list_filter({QUERY.split()}, lambda y: NOT list_contains(matched_terms, y)) AS missed_terms,
  round(least(1, 0.2 + 0.35 * covered / {len(QUERY.split())} + 0.25 * CASE WHEN r2 <= 0 THEN 1 ELSE least(1, greatest(0, (r1 / r2 - 1) / 1.5)) END + CASE WHEN list_contains(top, 'exact-path-shape') THEN 0.1 ELSE 0 END + CASE WHEN list_contains(top, 'symbol-match') THEN 0.1 ELSE 0 END)::DOUBLE, 3) AS confidence FROM packs
"""
SQL["evidence_files"] = _OF_SEEDS + f"""
, sf AS (SELECT repo, min(path) AS seed FROM f WHERE {_IS_TEST} GROUP BY repo
), pk AS (SELECT repo, list(path ORDER BY k) AS paths, count(*) FILTER (k <= 3 AND len(neighbors) > 0) AS near, count(*) FILTER (k <= 3 AND focus_start IS NOT NULL) AS focused FROM ef GROUP BY repo)
SELECT pk.repo, 'files' AS mode, paths, [seed] AS seed_files, round(least(1, 0.45 + 0.35 * list_contains(paths, seed)::INT + 0.1 * least(1, near / 3.0) + 0.1 * least(1, focused / 3.0))::DOUBLE, 3) AS confidence FROM pk JOIN sf ON sf.repo = pk.repo
"""


@_query
def import_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Import targets of all files by patterns alone, with how often each is found in a file."""
    from ..extract.operator import imports_by_pattern

    found = imports_by_pattern(table(spark, d, "files").select("repo", "path", "content").distinct())
    return found.groupBy("repo", "path", "target_name").agg(F.count(F.lit(1)).alias("n"))


_BY_PATTERN = {"py": ("python",), "pyi": ("python",), "ts": ("typescript",), "tsx": ("typescript",), "go": ("go",), "rs": ("rust",), "java": ("java",), "js": ("javascript",), "jsx": ("javascript",), "mjs": ("javascript",), "cjs": ("javascript",)}
_FINDS = " UNION ALL ".join(
    f"SELECT repo, path, unnest(regexp_extract_all(c, '(?m-s:{p})', 1)) AS target_name FROM g WHERE ext = '{e}'".replace("['\"]", "[''\"]").replace("[^'\"]", "[^''\"]") for e, (k,) in _BY_PATTERN.items() for p in IMPORT_PATTERNS[k]
)
SQL["import_patterns"] = rf"""
WITH x AS (SELECT DISTINCT repo, path, content FROM files), v AS (SELECT repo, path, regexp_extract(lower(path), '\.([^.]+)$', 1) AS ext, try(decode(content)) AS c FROM x)
, g AS (SELECT * FROM v WHERE c IS NOT NULL AND NOT contains(c, chr(0)))
SELECT repo, path, target_name, count(*) AS n FROM ({_FINDS}) GROUP BY ALL
"""


@_query
def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols scanned from the contents of all files."""
    from ..extract.operator import extract

    return index.symbols_of(extract(table(spark, d, "files").select("repo", "path", "content").distinct()))


@_query
def extracted_references(spark: SparkSession, d: str) -> DataFrame:
    from ..extract.operator import extract

    return index.references_of(extract(table(spark, d, "files").select("repo", "path", "content").distinct()))


MAP_TOKENS = 1024


def _maps(spark: SparkSession, d: str, budget: int, kind: str = "markdown") -> DataFrame:
    from .maps import render_all

    return render_all(files(spark, d, "language", "symbols"), factored.scores(parts(spark, d)).select("repo", "path", "score"), budget, estimate, (kind,))


@_query
def rendered_maps(spark: SparkSession, d: str) -> DataFrame:
    """The map of every repository in a budget of MAP_TOKENS, as Markdown; tokens by the estimate, which needs no vocabulary."""
    return _maps(spark, d, MAP_TOKENS).select("repo", "files_total", "markdown")


@_query
def rendered_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same without a limit that matters: all candidates in full."""
    return _maps(spark, d, 10_000_000).select("repo", "files_total", "markdown")


@_query
def rendered_json(spark: SparkSession, d: str) -> DataFrame:
    return _maps(spark, d, MAP_TOKENS, "json").select("repo", "files_total", "json")


_COUNT = r"""coalesce(list_sum(list_transform(regexp_extract_all({}, '(?i)''(?:[sdmt]|ll|ve|re)|[^\r\n\w]?[^\W\d_]+|\d{1,3}| ?[^\s\w]+[\r\n]*|_+|\s*[\r\n]|\s+'), lambda y: greatest(1, (strlen(y) + 2) // 3))), 0)"""


def _count(text: str) -> str:
    return _COUNT.replace("{}", text, 1)


def _maps_sql(budget: int, candidates: int) -> str:
    """SQL of the cut into a budget: a row a candidate, each with what was used before it."""
    nl = "chr(10)"
    full = f"head || '```' || fence || {nl} || array_to_string(list_transform(symbols[1:y], lambda z: z.signature || {nl}), '') || '```' || {nl}"
    related = f"{nl} || '### Related files' || {nl}"
    return BASE + _EDGES + _GLOBAL + _PLACED + f"""
, i0 AS (SELECT *, {nl} || '### ' || path || {nl} || CASE WHEN summary IS NOT NULL THEN '> ' || summary || {nl} || {nl} ELSE {nl} END AS head, {nl} || '### ' || path || {nl} || {nl} AS bare,
    CASE WHEN language IS NULL OR language IN ('unknown', 'binary') THEN '' ELSE language END AS fence FROM o2 WHERE rank <= {candidates}
), i1 AS (
  SELECT repo, rank, n, tier, bare, CASE WHEN tier = 1 AND len(symbols) > 0 THEN list_transform(range(1, len(symbols) + 1), lambda y: {full}) ELSE [] END AS parts,
    CASE WHEN tier = 1 THEN head WHEN tier = 2 THEN head || array_to_string(list_transform(symbols, lambda z: '- ' || z.name || {nl}), '') WHEN tier = 3 THEN '- `' || path || '`' || CASE WHEN summary IS NOT NULL THEN ' — ' || summary ELSE '' END || {nl} ELSE '' END AS plain FROM i0
), i2 AS (
  SELECT repo, rank, n, tier, bare, parts, CASE WHEN len(parts) > 0 THEN parts[-1] ELSE plain END AS text, {_count("bare")} AS bare_cost, list_transform(parts, lambda q: {_count("q")}) AS costs FROM i1
), i3 AS (SELECT *, {_count("text")} AS cost FROM i2
), wr AS (
  SELECT repo, 0 AS rank, {_count("title")}::BIGINT AS used, title AS md, false AS related, false AS done FROM (SELECT DISTINCT repo, '## Relevant Context' || {nl} AS title FROM i3)
  UNION ALL
  SELECT repo, rank, (used + heading + coalesce({_count("piece")}, 0))::BIGINT, md || CASE WHEN piece IS NOT NULL AND tier = 3 AND NOT listed THEN {related} ELSE '' END || coalesce(piece, ''), related OR tier = 3, done OR tier = 3 AND piece IS NULL FROM (
    SELECT w.repo, i.rank, w.used, w.md, w.related, w.done, i.tier, h.heading, contains(w.md, {related}) AS listed,
      CASE WHEN i.tier < 3 AND {budget} - w.used < 20 THEN NULL WHEN i.tier = 4 OR w.done THEN NULL WHEN w.used + h.heading + i.cost <= {budget} THEN i.text WHEN i.tier > 1 THEN NULL
        WHEN len(list_filter(i.costs, lambda q: q <= {budget} - w.used)) > 0 THEN i.parts[len(list_filter(i.costs, lambda q: q <= {budget} - w.used))] WHEN i.bare_cost <= {budget} - w.used THEN i.bare END AS piece
    FROM wr w JOIN i3 i ON i.repo = w.repo AND i.rank = w.rank + 1, LATERAL (SELECT CASE WHEN i.tier = 3 AND NOT w.related THEN {_count(related)} ELSE 0 END AS heading) h)
)
SELECT wr.repo, t.n AS files_total, CASE WHEN md = '## Relevant Context' || {nl} THEN md || '<!-- No files to display -->' || {nl} ELSE md END AS markdown
FROM wr JOIN (SELECT repo, max(rank) AS last, any_value(n)::BIGINT AS n FROM i3 GROUP BY repo) t ON t.repo = wr.repo AND t.last = wr.rank
"""


SQL["rendered_maps"] = _maps_sql(MAP_TOKENS, MAP_TOKENS // 24)
SQL["rendered_whole"] = _maps_sql(10_000_000, 128)
