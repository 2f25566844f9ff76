"""Generated, minified, vendored and data files among source files.

Evidence, in this order:

* notices in the file's header comment, found by one multi-pattern automaton over all files;
* path rules: directories and suffixes of generators, package layouts below vendored directories,
  suffixes of minified files and lockfiles (these two are the method, ``by_notice_and_path``);
* for files with neither, which the method cannot see, known third-party content: the hash of an upstream file, or the body of a file that is vendored by other evidence;
* the shape of the whole content: share of text in overlong lines, share of text that is literal
  data, and runs of lines that differ only by a counter.

A notice counts only in the header comment, so a file that prints, quotes or serves notices in its
code stays hand-written, and only where it is said of the file: at the beginning of a sentence, or
after words like "this file was". A directory that is merely called like a vendored one counts only
with a package's layout below it or a licence in the header.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Notices of generators and of third-party releases as they stand in headers, in lower case.
NOTICES = {
    "generated": [
        "generated by the", "generated by", "@generated", "automatically generated", "<auto-generated", "auto-generated", "autogenerated",
        "code generated", "generated from", "machine generated", "do not edit", "fichier produit par", "généré par", "généré automatiquement",
        "automatisch erzeugt", "automatisch generiert", "generado por", "generado automáticamente", "wygenerowano", "changes will be lost",
        "edits are overwritten",
    ],
    "vendored": [
        "standalone build", "bundled copy", "is granted to use, copy and modify", "released under a permissive license", "permission is hereby granted",
    ],
    "license": [
        "mit license", "bsd license", "apache license", "mozilla public license", "gnu general public license", "gnu lesser general public license", "isc license", "spdx-license-identifier",
        "released under the", "licensed under the mit", "licensed under the apache", "licensed under the bsd", "redistribution and use in source and binary forms",
    ],
}
# What may stand before a notice in its sentence when it is said of the file itself.
SAID_OF_FILE = frozenset("this file files code source module class content contents stub stubs bindings is was are were has have been it automatically auto machine the following note warning attention please any all manual".split())
# A header that says the generator's output was taken over by hand outweighs a notice.
BY_HAND = ("by hand after", "edit freely", "no longer generated", "not generated")

GENERATED_PATH = re.compile(
    r"(?:^|/)(?:generated|__generated__|gen|autogen)/|(?:\.pb\.(?:go|cc|h)|_pb2?(?:_grpc)?\.\w+|[_.-](?:gen|generated|g)\.\w+|\.designer\.\w+)$", re.I
)
MINIFIED_PATH = re.compile(r"\.min\.\w+$", re.I)
DATA_PATH = re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|go\.sum|composer\.lock)$", re.I)
# Directories of third-party packages only: whatever lies in a package's folder below counts.
PACKAGES_PATH = re.compile(r"(?:^|/)(?:vendored|third[_-]?party|node_modules|bower_components|site-packages)/(?:@[\w-]+/)?[\w.@+-]+/(?:[^/]+/)*[^/]+$", re.I)
NODE_MODULES = re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages)/", re.I)
# Names that also stand for things of the project's own: below them a package shows by a host name, by a file called
# like its folder, or by an entry file of the folder.
VENDORED_PATH = re.compile(
    r"(?:^|/)(?:vendor|deps|externals?)/(?:@[\w-]+/)?(?:[\w-]+(?:\.[\w-]+)+/(?:[^/]+/)+[^/]+|([\w.-]+)/(?:(?:[^/]+/)*\1[\d.-]*\.\w+|(?:index|mod|lib|__init__|setup)\.\w+|(?:src|lib|dist)/(?:[^/]+/)*(?:\1|index|mod|lib|main|__init__)[\d.-]*\.\w+))$", re.I
)
VENDORED_DIRECTORY = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|deps|externals?)/", re.I)
RELEASE = re.compile(r"^\W*(?:part of the ([a-z][\w.-]*) library, release \d|([a-z][\w.-]*) v?\d+\.\d+\.\d+\b)", re.I | re.M)
MAINTAINERS = re.compile(r"copyright(?: \(c\))? \d{4}(?:-\d{4})? the ([\w-]+) maintainers", re.I)

LONG_LINE = 240
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b0x[0-9a-fA-F]+\b|\b\d[\d_.eE]*\b|[\s\[\](){},:;=+-]+")
_HEADER = re.compile(r"(?:\s+|#[^\n]*|//[^\n]*|--[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|<!--.*?(?:-->|\Z))*", re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_NUMBER = re.compile(r"\d+")

_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """All notices in one Aho-Corasick automaton, built once a worker."""
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for sort, phrases in NOTICES.items():
            for p in phrases:
                a.add_word(p, (sort, p))
        for p in BY_HAND:
            a.add_word(p, ("by_hand", p))
        a.make_automaton()
        _automaton = a
    return _automaton


_SENTENCE = re.compile(r"[.;:!?\u2013\u2014]\s+|[.;:!?]$|--+")


def notices_in(header: str) -> dict[str, str]:
    """The notices a header says of its file, the first of each sort; a notice carries those after it in its line."""
    low = header.lower()
    found: dict[str, str] = {}
    carried = -1  # the end of the last line with a notice
    for last, (sort, phrase) in automaton().iter(low):
        at = last - len(phrase) + 1
        line = low.rfind("\n", 0, at) + 1
        before = _SENTENCE.split(low[line:at])[-1]
        said = line <= carried or all(w in SAID_OF_FILE for w in _LETTERS.findall(before))
        if sort in ("license", "by_hand") or said:
            found.setdefault(sort, phrase)
            if sort == "generated":
                carried = at
    return found


_LETTERS = re.compile(r"[^\W\d_]+")


def header_of(text: str) -> str:
    """The comments and blank lines before the first code."""
    return _HEADER.match(text.removeprefix("﻿")).group(0)


_COMMENT_LINE = re.compile(r"^[ \t]*(?://|#|/\*|\*).*$", re.M)


def body_key(text: str) -> bytes | None:
    """A fingerprint of the code without its header, lines of comment and blanks; none for bodies under ``LEAST_BODY``."""
    body = "".join(_COMMENT_LINE.sub("", text[len(header_of(text)) :].replace("\r", "\n")).split())
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest() if len(body) >= LEAST_BODY else None


def counter_share(text: str) -> tuple[int, float]:
    """Lines whose number goes on counting from the line of the same shape before, and their block's share of the text.

    Accessor tables and constant tables written by tools count on in fixed steps; names and other
    words are taken out of the shapes.
    """
    last: dict[str, int] = {}
    seen: dict[str, int] = {}
    counted = total = 0
    shapes_counted: set[str] = set()
    lines = [ln for ln in text.splitlines() if ln.strip()]
    for ln in lines:
        total += 1
        shape = _NUMBER.sub("9", _WORD.sub("w", ln))
        seen[shape] = seen.get(shape, 0) + 1
        numbers = _NUMBER.findall(_WORD.sub("w", ln))
        if numbers and len(numbers[-1]) <= 18:  # what counts lines is no longer number
            n = int(numbers[-1])
            if last.get(shape) == n - 1:
                counted += 1
                shapes_counted.add(shape)
            last[shape] = n
    if not counted:
        return 0, 0.0
    # Shapes that come as often as the counted ones belong to the same template.
    often = max(seen[s] for s in shapes_counted)
    block = sum(n for s, n in seen.items() if n >= 0.9 * often)
    return counted, block / total


def by_notice_and_path(path: str, header: str) -> tuple[str, str, bool] | None:
    """The method alone, the automaton's notices and the path rules: sort, evidence and whether a notice decided."""
    found = notices_in(header) if header.strip() else {}
    if "by_hand" not in found:
        if "generated" in found:
            return "generated", f"notice: {found['generated']}", True
        if "vendored" in found and (RELEASE.search(header) or VENDORED_DIRECTORY.search(path)):
            return "vendored", f"notice: {found['vendored']}", True
    if VENDORED_PATH.search(path) or PACKAGES_PATH.search(path) or NODE_MODULES.search(path):
        return "vendored", "path of a package", False
    if VENDORED_DIRECTORY.search(path) and ("license" in found or "vendored" in found):
        return "vendored", "licence in a vendored directory", True
    if GENERATED_PATH.search(path):
        return "generated", "path of generated files", False
    if DATA_PATH.search(path):
        return "data", "lockfile", False
    if MINIFIED_PATH.search(path):
        return "minified", "path of minified files", False
    return None


def sort_of(path: str | None, repo: str | None, content: bytes | None) -> tuple[str, str, str | None, bool]:
    """One file's sort, the evidence, whose maintainers' notice it holds (if not the repository's) and whether a notice decided.

    The sorts are ``generated, minified, vendored, data`` and ``hand_written``.
    """
    path = (path or "").replace("\\", "/")
    text = (content or b"").decode("utf-8", "replace")
    header = header_of(text)
    maintainer = None
    if (m := MAINTAINERS.search(header)) and m.group(1).lower() != (repo or "").lower() and "by_hand" not in notices_in(header):
        maintainer = m.group(1).lower()
    if told := by_notice_and_path(path, header):
        return told[0], told[1], None if told[2] else maintainer, told[2]
    body = text[len(header) :]
    size = len(body.strip())
    if size >= LEAST_BODY:
        residue = len(_LITERAL.sub("", body))
        if residue < DATA_RESIDUE * size and residue <= DATA_CODE + 0.01 * size:
            return "data", f"literals: {1 - residue / size:.2f} of the text", maintainer, False
        if any(len(ln) > LONG_LINE for ln in body.splitlines()):
            code = _STRING.sub('""', body)
            overlong = sum(len(ln) for ln in code.splitlines() if len(ln) > LONG_LINE)
            if overlong > 0.5 * len(code):
                return "minified", f"overlong lines: {overlong / len(code):.2f} of the code", maintainer, False
        if _COUNTS_ON.search(body):
            counted, share = counter_share(body)
            if counted >= COUNTED and share >= COUNTED_SHARE:
                return "generated", f"counter runs over {share:.2f} of the lines", maintainer, False
    return "hand_written", "", maintainer, False


#: Parameters of what the content tells. Bodies under LEAST_BODY characters are too short to tell a table, one line or a
#: copy from common code (two files with nothing but an import would be copies of each other); they go by the rest.
LEAST_BODY = 200
DATA_RESIDUE = 0.07
DATA_CODE = 80  # characters of declarations around a table; whole functions take more
COUNTED = 40
COUNTED_SHARE = 0.6
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
# A body can only count on for COUNTED lines if the number COUNTED - 1 or a greater one stands in it.
_COUNTS_ON = re.compile(r"(?<![\w.])(?:39|[4-9]\d|[1-9]\d\d+)(?![\w.])")

def classify_by_method(files: DataFrame) -> DataFrame:
    """``file_id, repo, path, sort, evidence`` of every distinct file by notices and path rules alone; cases as in ``classify_files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                got.append(by_notice_and_path((p or "").replace("\\", "/"), header_of((c or b"").decode("utf-8", "replace"))) or ("hand_written", "", False))
            yield pa.record_batch([*b.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["file_id", "repo", "path", "sort", "evidence"])

    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "path", "content")
    judged = rows.mapInArrow(run, "file_id bigint, repo string, path string, sort string, evidence string")
    key = F.struct("file_id", F.when(F.col("file_id").isNull(), F.monotonically_increasing_id()).alias("row")).alias("_u")
    return judged.withColumn("_u", key).groupBy("_u").agg(F.min(F.struct("file_id", "repo", "path", "sort", "evidence")).alias("r")).select("r.*")


_OUT = "file_id bigint, repo string, path string, hash string, sort string, evidence string, maintainer string, noticed boolean, body binary"


def classify_files(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """Every distinct file with its sort: ``file_id, repo, path, sort, evidence``.

    ``files`` needs ``file_id, repo, path, content_hash, content``; ``upstream`` needs ``package,
    content_hash``. Other columns are ignored. One pass over the content, which is never shuffled;
    the upstream hashes and package names then meet the judged rows in equi-joins.

    Defined cases: rows of one file are judged once (the smallest judgement if they differ; rows
    without an id each for themselves); a null path, repo or content counts as empty; an empty file
    is hand-written; content that isn't UTF-8 is judged by its path and what decodes; empty tables
    give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sort_of(p, r, c) for r, p, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 4)))]
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
            made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            bodies = pa.array([body_key((c or b"").decode("utf-8", "replace")) for c in b.column(4).to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns[:4], *made, bodies], ["file_id", "repo", "path", "hash", "sort", "evidence", "maintainer", "noticed", "body"])

    judged = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "path", F.lower("content_hash").alias("hash"), "content").mapInArrow(run, _OUT)
    key = F.struct("file_id", F.when(F.col("file_id").isNull(), F.monotonically_increasing_id()).alias("row")).alias("_u")
    row = F.struct("file_id", "repo", "path", "sort", "evidence", "hash", "maintainer", "noticed", "body")
    once = judged.withColumn("_u", key).groupBy("_u").agg(F.min(row).alias("r")).select("r.*")
    known = upstream.filter(F.col("content_hash") != "").select(F.lower("content_hash").alias("_h"), F.lit(True).alias("_up")).distinct()
    packages = upstream.filter(F.col("package").isNotNull()).select(F.lower("package").alias("_p"), F.lit(True).alias("_pk")).distinct()
    joined = once.join(known, F.col("hash") == F.col("_h"), "left").join(packages, F.col("maintainer") == F.col("_p"), "left")
    theirs = F.col("_pk") & ~F.col("noticed")
    told = joined.select(
        "file_id",
        "repo",
        "path",
        F.when(F.col("_up") | theirs, F.lit("vendored")).otherwise(F.col("sort")).alias("sort"),
        F.when(F.col("_up"), F.lit("upstream content"))
        .when(theirs, F.concat(F.lit("notice: maintainers of "), "maintainer"))
        .otherwise(F.col("evidence"))
        .alias("evidence"),
        "body",
    )
    # A copy without its notice, outside of any vendored folder, shows by its body: one row per distinct body on that side.
    told = materialize(told, "told")
    copied = told.filter("sort = 'vendored' AND body IS NOT NULL").select(F.col("body").alias("_b"), F.lit(True).alias("_copy")).distinct()
    copy = (F.col("sort") == "hand_written") & F.coalesce("_copy", F.lit(False))
    return told.join(copied, F.col("body") == F.col("_b"), "left").select(
        "file_id",
        "repo",
        "path",
        F.when(copy, F.lit("vendored")).otherwise(F.col("sort")).alias("sort"),
        F.when(copy, F.lit("body of a vendored file")).otherwise(F.col("evidence")).alias("evidence"),
    )
