"""The extraction operator: file contents to index rows, in Arrow batches."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import FILES
from ..sources.scan import describe
from .scanner import scan, search_imports

log = logging.getLogger("siltstone")

_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("signature", pa.string()), ("parent", pa.string()), ("end_line", pa.int32()), ("ord", pa.int32())])
_REFERENCE = pa.struct([("source_file", pa.string()), ("target_name", pa.string()), ("target_file", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("ord", pa.int32())])
_SCHEMA = pa.schema([("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("content_hash", pa.string()), ("lines", pa.int32()), ("symbols", pa.list_(_SYMBOL)), ("refs", pa.list_(_REFERENCE))])


def extract(contents: DataFrame) -> DataFrame:
    """Index rows (``repo, path, language, content_hash, lines, symbols, refs``) of ``repo, path, content``.

    Language, hash and line count come from the JVM; only text of a known language goes on to the
    scanners. A file a scanner fails on keeps its row without symbols. Nothing is shuffled but the
    contents' own partitions.
    """
    rows = describe_with_content(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages, paths, texts = (b.column(i).to_pylist() for i in (2, 1, 5))
            symbols, refs = [], []
            for language, path, text in zip(languages, paths, texts):
                try:
                    s, r = scan(text or "", language, path)
                except (RecursionError, ValueError, IndexError):
                    log.warning("cannot scan %s", path)
                    s, r = [], []
                symbols.append(s)
                refs.append(r)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(symbols, pa.list_(_SYMBOL)), pa.array(refs, pa.list_(_REFERENCE))], schema=_SCHEMA)

    return rows.mapInArrow(run, FILES)


def describe_with_content(contents: DataFrame) -> DataFrame:
    """``describe`` with the decoded text beside it, null for binary and undecodable content."""
    keep = describe(contents.select("repo", "path", "content"), keep_content=True)
    return keep.select("repo", "path", "language", "content_hash", "lines", F.expr("if(language in ('binary', 'unknown'), null, cast(content as string))").alias("text"))


def imports_by_pattern(contents: DataFrame) -> DataFrame:
    """``repo, path, target_name, line`` by the import patterns alone."""
    rows = describe_with_content(contents).filter("text is not null").select("repo", "path", "language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r, p, n, ln) for r, p, k, x in zip(*(c.to_pylist() for c in b.columns)) for n, ln in search_imports(x, k)]
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], ["repo", "path", "target_name", "line"])

    return rows.mapInArrow(run, "repo string, path string, target_name string, line int")
