"""Source files that do not parse in their language, and the rates of such files.

Every file is read as a whole by the packrat grammar of its language (``syntax``): it is valid only
if the grammar consumes all of it. For an invalid file the furthest failure and its cause are
reported: leftover conflict markers, content of another language, truncation, an unbalanced bracket,
an illegal or unterminated token, or what stood there in place of what was wanted.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .syntax.languages import EXTENSIONS, LANGUAGES, language

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?$|^={7}$", re.M)
_OUT = "file_id bigint, repo string, path string, language string, valid boolean, line int, offset int, cause string"


def known_language(language_col: str = "language", path_col: str = "path") -> Column:
    """The language as listed, in lower case without blanks; by the path's extension where it is null."""
    extension = F.lower(F.regexp_extract(F.translate(F.col(path_col), "\\", "/"), r"[^/]\.([^./]+)$", 1))
    by_extension = F.create_map([F.lit(x) for kv in EXTENSIONS.items() for x in kv])[extension]
    return F.coalesce(F.nullif(F.lower(F.btrim(F.col(language_col))), F.lit("")), by_extension)


def judge(content: bytes | None, name: str, detail: bool = True, markup: bool = False) -> tuple[bool | None, int, int, str]:
    """Whether a file's content is valid in a language, else line and offset of the furthest failure and the cause.

    ``markup`` admits JSX. None stands for a file nested too deeply to be judged.
    """
    try:
        text = (content or b"").decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as e:
        return False, (content or b"")[: e.start].count(b"\n") + 1, e.start, "not UTF-8"
    parser = language(name)
    if not detail:
        return parser.valid(text, markup), 0, 0, ""
    valid, at, cause = parser.check(text, markup)
    if valid:
        return True, 0, 0, ""
    if valid is None:
        return None, 0, 0, cause
    if _CONFLICT.search(text):
        cause = "merge conflict"
    else:
        for other in LANGUAGES:
            if other != name and text.strip() and language(other).valid(text):
                cause = f"content is {other}"
                break
    return False, text.count("\n", 0, at) + 1, at, cause


#: Extensions whose files may hold JSX elements.
MARKUP = (".tsx", ".jsx")


def check_files(files: DataFrame, detail: bool = True, markup: tuple[str, ...] = MARKUP) -> DataFrame:
    """Every distinct file of a known language with its judgement.

    Returns ``file_id, repo, path, language, valid, line, offset, cause``; ``line`` and ``offset`` (in
    characters, line ends counted as one) are those of the furthest failure. ``files`` needs ``file_id,
    repo, path, language, content``; other columns are ignored. Contents are not shuffled. JSX elements are
    part of the language in files whose path ends in one of ``markup``.

    Defined cases: a null language is told by the path's extension; files of other languages
    (``binary`` and ``unknown`` among them) are left out; null and empty content is valid; content
    that is not UTF-8 is not; ``valid`` is null where a chain of some hundred thousand else-ifs or the like is too
    deep to be judged (brackets may nest to any depth); rows of one file are judged once (invalid if any row is), rows without
    an id each for themselves; empty tables give an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
        for b in batches:
            paths, names, contents = (b.column(i).to_pylist() for i in (2, 3, 4))
            got = [judge(c, n, detail, (p or "").lower().endswith(markup)) for p, n, c in zip(paths, names, contents)]
            made = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.bool_(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.record_batch([*b.columns[:4], *made], ["file_id", "repo", "path", "language", "valid", "line", "offset", "cause"])

    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo", "path", known_language().alias("language"), "content")
    judged = rows.filter(F.col("language").isin(*LANGUAGES)).mapInArrow(run, _OUT)
    key = F.struct("file_id", F.when(F.col("file_id").isNull(), F.monotonically_increasing_id()).alias("row")).alias("_u")
    first = F.min(F.struct("valid", "file_id", "repo", "path", "language", "line", "offset", "cause"))
    once = judged.withColumn("_u", key).groupBy("_u").agg(first.alias("r")).select("r.*")
    return once.select("file_id", "repo", "path", "language", "valid", "line", "offset", "cause")


def rates(checked: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_invalid, rate`` by repository and language; cubed, so null stands for all."""
    return (
        checked.cube("repo", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.grouping_id().alias("level"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
