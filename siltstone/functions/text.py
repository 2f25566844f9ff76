"""Column expressions on names and paths. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(c: Column | str) -> Column:
    """A name without outer blanks and tabs; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t"))


def clean_kind(c: Column | str) -> Column:
    """A kind in lower case without outer blanks; null stays null."""
    return F.lower(clean_name(c))


def normalize_path(c: Column | str) -> Column:
    """POSIX normal form: ``\\`` read as ``/``, ``.``, ``..`` and doubled slashes resolved.

    An absolute path keeps one leading slash and ``..`` above a root vanishes; above a relative
    start it is kept; the empty path is ``.``; null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    slashed = F.translate(c, "\\", "/")
    rooted = slashed.startswith("/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        can_pop = (F.size(acc) > 0) & (top != "..")
        up = F.when(can_pop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(
            rooted, acc
        ).otherwise(F.concat(acc, F.array(p)))
        return F.when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    joined = F.array_join(F.when(F.array_contains(parts, ".."), folded).otherwise(parts), "/")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(rooted, F.concat(F.lit("/"), joined))
        .when(joined == "", F.lit("."))
        .otherwise(joined)
    )


def unique_or_row(id_col: Column) -> Column:
    """A grouping key that merges rows of one id but keeps every row without an id apart."""
    return F.struct(id_col.alias("id"), F.when(id_col.isNull(), F.monotonically_increasing_id()).alias("row"))


# Expressions as SQL text, so that they can stand inside lambdas of higher-order functions.

#: Fixed value: languages by extension.
LANGUAGE_OF_EXTENSION = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
}

#: Fixed value: words of a query that ask for tests.
TEST_WORDS = ("test", "tests", "spec", "specs", "pytest", "unittest")


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(items: list[str]) -> str:
    """A SQL array of string literals, typed even when empty."""
    return f"array({', '.join(map(lit, items))})" if items else "cast(array() as array<string>)"


def basename(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$', 0)"


def dirname(p: str) -> str:
    """Parent folder, ``.`` at the top."""
    return f"if(contains({p}, '/'), regexp_replace({p}, '/[^/]*$', ''), '.')"


def stem(p: str) -> str:
    """Base name up to its last dot; a name that begins with its only dot has an empty stem."""
    return f"regexp_replace({basename(p)}, '\\\\.[^.]*$', '')"


def file_stem(p: str) -> str:
    """Base name without suffix; a leading dot begins no suffix."""
    return f"regexp_replace({basename(p)}, '(?<=.)\\\\.[^.]+$', '')"


def extension(p: str) -> str:
    """Suffix with its dot in lower case, empty if there is none."""
    return f"regexp_extract(lower({p}), '[^/]+(\\\\.[^./]+)$', 1)"


def language_of(p: str) -> str:
    """Language by extension, null for others."""
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in LANGUAGE_OF_EXTENSION.items())
    return f"try_element_at(map({pairs}), {extension(p)})"


def tokenize(t: str) -> str:
    """Words of code-like text: each run of word characters, its parts at ``_`` and its parts at capitals, in lower case."""
    none = "cast(array() as array<string>)"
    under = f"if(contains(w, '_'), transform(filter(split(w, '_'), y -> y <> ''), y -> lower(y)), {none})"
    camel = f"if(substring(w, 2) rlike '[A-Z]', transform(filter(split(w, '(?<!^)(?=[A-Z])'), y -> y <> '' and y <> w), y -> lower(y)), {none})"
    return f"flatten(transform(regexp_extract_all({t}, '[A-Za-z0-9_]+', 0), w -> concat(array(lower(w)), {under}, {camel})))"


def compact(t: str) -> str:
    """Letters and digits only, in lower case."""
    return f"lower(regexp_replace({t}, '[^\\\\p{{L}}\\\\p{{N}}]', ''))"


def in_order(tokens: str, words: str) -> str:
    """Whether the words come in this order among the tokens."""
    return f"(size({words}) > 0 and aggregate({tokens}, 0, (i, x) -> if(x <=> try_element_at({words}, i + 1), i + 1, i)) = size({words}))"


def is_test_path(p: str) -> str:
    b = f"lower({basename(p)})"
    return (
        f"(contains(lower({p}), '/tests/') or contains(lower({p}), '/__tests__/') or startswith({b}, 'test_') or endswith({b}, '_test.py')"
        f" or contains({b}, '.test.') or contains({b}, '.spec.'))"
    )


def python_tokenize(text: str) -> list[str]:
    """``tokenize`` for a query on the driver."""
    import re

    out: list[str] = []
    for w in re.findall(r"[A-Za-z0-9_]+", text):
        out.append(w.lower())
        if "_" in w:
            out += [p.lower() for p in w.split("_") if p]
        if re.search("[A-Z]", w[1:]):
            out += [p.lower() for p in re.split(r"(?<!^)(?=[A-Z])", w) if p and p != w]
    return out


def python_compact(text: str) -> str:
    """``compact`` for a query on the driver."""
    return "".join(c.lower() for c in text if c.isalnum())


def line_count(c: str) -> str:
    """Lines of a text; an unended last line counts, an empty text has none."""
    return f"length({c}) - length(replace({c}, '\\n', '')) + if({c} <> '' and not endswith({c}, '\\n'), 1, 0)"
