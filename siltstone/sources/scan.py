"""Scanning repositories: listing, reading, sentinels, hashes and line counts."""

from __future__ import annotations

import logging
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

log = logging.getLogger("siltstone")

#: Folders that a walk without version control skips, and its limits.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", "target", ".eggs")
MAX_FILES, MAX_BYTES, LIST_SECONDS = 10_000, 1_000_000, 30


def describe(files: DataFrame, keep_content: bool = False) -> DataFrame:
    """``repo, path, language, content_hash, lines`` from ``repo, path, content``, all inside the JVM.

    A NUL byte among the first 8192 makes a file ``binary``, invalid UTF-8 or an unknown extension
    ``unknown``; the first two have no hash and no lines. Null content counts as empty.
    """
    c = "coalesce(content, X'')"
    rows = files.select("repo", "path", F.expr(c).alias("content"), F.expr(f"position(X'00' IN substring({c}, 1, 8192)) > 0").alias("nul"), F.expr(f"is_valid_utf8(cast({c} as string))").alias("valid"))
    text = "cast(content as string)"
    return rows.select(
        "repo", "path",
        F.expr(f"case when nul then 'binary' when not valid then 'unknown' else coalesce({t.language_of('path')}, 'unknown') end").alias("language"),
        F.expr("if(nul or not valid, '', sha2(content, 256))").alias("content_hash"),
        F.expr(f"if(nul or not valid, 0, {t.line_count(text)})").alias("lines"), *(["content"] if keep_content else []),
    )


def tracked_paths(root: str) -> list[str] | None:
    """Paths that git tracks below the root, or none where git can't tell."""
    try:
        done = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, timeout=LIST_SECONDS)
    except (OSError, subprocess.SubprocessError):
        return None
    return [p for p in done.stdout.decode("utf-8", "surrogateescape").split("\0") if p] if done.returncode == 0 else None


def walked_paths(root: str) -> list[str]:
    """Paths below a root without version control, in order, under the fixed limits of a walk."""
    out: list[str] = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in SKIPPED_FOLDERS and not n.endswith(".egg-info"))
        for name in sorted(files):
            full = os.path.join(folder, name)
            try:
                if os.path.getsize(full) > MAX_BYTES:
                    continue
            except OSError:
                continue
            out.append(os.path.relpath(full, root))
            if len(out) >= MAX_FILES:
                log.warning("only the first %d files are listed", MAX_FILES)
                return out
    return out


def _escaped(path: str) -> str:
    return re.sub(r"([{}\[\]*?,\\])", r"\\\1", path)


def read_repository(spark: SparkSession, root: str, languages: list[str] | None = None, repo: str = "") -> DataFrame:
    """``repo, path, content`` of the supported files below a root, only of ``languages`` if given.

    Tracked files come from git; elsewhere the tree is walked, without hidden and skipped folders and
    files over 1,000,000 bytes, up to 10,000 files. Extensions are filtered before anything is read,
    and files that vanish meanwhile are left out.
    """
    root = os.path.realpath(root)
    extensions = {e for e, k in t.LANGUAGE_OF_EXTENSION.items() if not languages or k in languages}
    listed = tracked_paths(root)
    if listed is None:
        log.warning("not under version control, walking the folder: %s", root)
        listed = walked_paths(root)
    sizes = {p: os.path.getsize(os.path.join(root, p)) for p in listed if os.path.splitext(p)[1].lower() in extensions and os.path.isfile(os.path.join(root, p))}
    # The reader passes over files without bytes, so they are rows of their own.
    empty = spark.createDataFrame([(repo, p, b"") for p, n in sizes.items() if not n], "repo string, path string, content binary")
    full = [_escaped(os.path.join(root, p)) for p, n in sizes.items() if n]
    if not full:
        return empty
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(full)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return raw.select(F.lit(repo).alias("repo"), F.substring(plain, len(root.rstrip("/")) + 2, 1_000_000).alias("path"), "content").unionByName(empty)
