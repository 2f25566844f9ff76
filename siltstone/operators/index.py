"""The index as tables: files with nested symbols and references, and their flat views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

SYMBOL = "struct<name:string,kind:string,file:string,line:int,signature:string,parent:string,end_line:int,ord:int>"
REFERENCE = "struct<source_file:string,target_name:string,target_file:string,line:int,kind:string,ord:int>"
FILES = f"repo string, path string, language string, content_hash string, lines int, symbols array<{SYMBOL}>, refs array<{REFERENCE}>"

#: Edge kinds with their weights; any other kind weighs 1.
WEIGHTS = {"tests": 1.25, "imports": 1.0, "calls": 0.9, "uses_type": 0.8, "inherits": 0.75, "implements": 0.75}
SYMBOL_KINDS = ("class", "function", "method", "variable", "type", "interface", "enum", "constant", "module")


COLUMNS = ("language", "content_hash", "lines", "symbols", "refs")


def current_files(files: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row a file: ``repo, path`` and the named ones of ``language, content_hash, lines, symbols, refs``.

    Only what is named is read and moved. Of rows of one (repo, path) the latest by ``indexed_at`` and
    ``run_id`` stays; a null language is told by the extension, null arrays are empty, rows without
    repository or path are left out.
    """
    made = {
        "language": F.expr(f"coalesce(language, {t.language_of('path')}, 'unknown')"),
        "content_hash": F.coalesce("content_hash", F.lit("")),
        "lines": F.coalesce("lines", F.lit(0)),
        "symbols": F.expr(f"coalesce(symbols, cast(array() as array<{SYMBOL}>))") if "symbols" in columns else None,
        "refs": F.expr(f"coalesce(refs, cast(array() as array<{REFERENCE}>))") if "refs" in columns else None,
    }
    row = F.struct("indexed_at", "run_id", *[made[c].alias(c) for c in columns])
    latest = files.filter("repo is not null and path is not null").groupBy("repo", "path").agg(F.max(row).alias("r"))
    return latest.select("repo", "path", *[f"r.{c}" for c in columns])


def symbols_of(files: DataFrame) -> DataFrame:
    """``repo, path, name, kind, line, signature, parent, end_line, ord`` of all symbols."""
    each = files.select("repo", "path", F.explode("symbols").alias("s"))
    return each.select("repo", "path", "s.name", "s.kind", "s.line", "s.signature", "s.parent", "s.end_line", "s.ord")


def references_of(files: DataFrame) -> DataFrame:
    """``repo, path, language, target_name, target_file, line, kind, ord`` of all references."""
    each = files.select("repo", "path", "language", F.explode("refs").alias("r"))
    return each.select("repo", "path", "language", "r.target_name", "r.target_file", "r.line", "r.kind", "r.ord")


def drop_functions_of_methods(symbols: DataFrame) -> DataFrame:
    """Without functions on whose line the file also has a method."""
    methods = symbols.filter("kind = 'method'").select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("line").alias("_l")).distinct()
    hit = (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")) & (F.col("kind") == "function")
    return symbols.join(methods, hit, "left_anti")


def stats(files: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_symbols, n_refs`` by repository and language."""
    return files.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.size("symbols")).alias("n_symbols"), F.sum(F.size("refs")).alias("n_refs")
    )
