"""Lexical scores of files and symbols for a query, as expressions over path and nested symbols.

The query's words are literals of the plan, so a score is one projection without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import lit, python_compact, python_tokenize, string_array

_SYMS = (
    "transform(coalesce(symbols, array()), s -> named_struct('name', lower(coalesce(s.name, '')), 'signature', lower(coalesce(s.signature, '')), 'tokens', "
    + t.tokenize("coalesce(s.name, '')")
    + ", 'compact', "
    + t.compact("coalesce(s.name, '')")
    + "))"
)


def lexical_score(words: list[str]) -> Column:
    """The score of a file (columns ``path, symbols``) for the query's words; 0 without words.

    Repeated words count repeatedly, and may thereby miss the bonus for covering all words.
    """
    if not words:
        return F.lit(0.0)
    many, query = len(words) > 1, python_compact("".join(words))
    kws = string_array(words)
    shape = "0.0D"
    if many:
        q = lit(query)
        variants = [sep.join(words) for sep in (" ", "_", "-", "/")]
        shape = f"""(case when cstem = {q} then 28.0D when {q} <> '' and contains(cstem, {q}) then 18.0D when {q} <> '' and contains(cpath, {q}) then 12.0D else 0.0D end
          + case when stokens = {kws} then 24.0D when {t.in_order('stokens', kws)} then 14.0D else 0.0D end
          + case when array_contains({string_array(variants)}, lstem) then 26.0D when {' or '.join(f'contains(base, {lit(v)})' for v in variants)} then 16.0D else 0.0D end)"""
    best = []
    for w in words:
        k = lit(w)
        symbol = f"greatest(case when s.name = {k} then 12.0D when array_contains(s.tokens, {k}) then 7.0D when contains(s.name, {k}) then 4.5D else 0.0D end, if(contains(s.signature, {k}), 1.5D, 0.0D)"
        if many:
            q = lit(query)
            symbol += f", case when {q} <> '' and s.compact = {q} then 22.0D when {q} <> '' and contains(s.compact, {q}) then 14.0D else 0.0D end"
            symbol += f", case when s.tokens = {kws} then 18.0D when {t.in_order('s.tokens', kws)} then 10.0D else 0.0D end"
        best.append(
            f"greatest(if(base = {k}, 8.0D, 0.0D), case when lstem = {k} then 9.0D when contains(base, {k}) then 5.0D else 0.0D end,"
            f" case when array_contains(ptokens, {k}) then 4.0D when contains(lower(path), {k}) then 2.5D else 0.0D end,"
            f" coalesce(array_max(transform(syms, s -> {symbol}))), 0.0D))"
        )
    # Each part is computed once: the names are bound by nested transforms over one-element arrays.
    unique = len(set(words))
    body = f"""aggregate(filter(array({', '.join(best)}), b -> b > 0), named_struct('sum', 0.0D, 'n', 0), (a, b) -> named_struct('sum', a.sum + b, 'n', a.n + 1),
      a -> {shape} + a.sum + a.n * 1.5D + if({unique} > 1 and a.n = {unique}, 6.0D, 0.0D))"""
    row = f"""named_struct('base', lower({t.basename('path')}), 'lstem', lower({t.stem('path')}), 'stokens', {t.tokenize(f"lower({t.stem('path')})")}, 'ptokens', {t.tokenize('path')},
      'cstem', {t.compact(t.stem('path'))}, 'cpath', {t.compact('path')}, 'syms', {_SYMS})"""
    for name in ("base", "lstem", "stokens", "ptokens", "cstem", "cpath", "syms"):
        body = _qualify(body, name)
    return F.expr(f"transform(array({row}), z -> {body})[0]")


def _qualify(sql: str, name: str) -> str:
    """``name`` as a field of ``z``, outside of string literals."""
    import re

    parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)
    return "".join(p if i % 2 else re.sub(rf"(?<![\w.]){name}\b", f"z.{name}", p) for i, p in enumerate(parts))


def symbol_score(words: list[str], s: str = "s") -> str:
    """SQL of a symbol's evidence score; ``s`` has ``name`` and ``signature``."""
    if not words:
        return "0.0D"
    name, sig, tokens, comp = f"lower({s}.name)", f"lower({s}.signature)", t.tokenize(f"{s}.name"), t.compact(f"{s}.name")
    parts = []
    if len(words) > 1:
        q, kws = lit(python_compact("".join(words))), string_array(words)
        parts.append(f"case when {q} <> '' and {comp} = {q} then 22.0D when {q} <> '' and contains({comp}, {q}) then 12.0D else 0.0D end")
        parts.append(f"case when {tokens} = {kws} then 18.0D when {t.in_order(tokens, kws)} then 10.0D else 0.0D end")
    for w in words:
        k = lit(w)
        parts.append(f"case when {name} = {k} then 10.0D when array_contains({tokens}, {k}) then 6.0D when contains({name}, {k}) then 4.0D when contains({sig}, {k}) then 1.0D else 0.0D end")
    return f"({' + '.join(parts)})"


def matched_terms(words: list[str], text: str) -> str:
    """SQL of the query's words found in a text, each once, in the query's order."""
    return f"array_distinct(filter({string_array(words)}, k -> contains(lower({text}), k) or array_contains({t.tokenize(text)}, k)))"


def summary(symbols: str = "symbols") -> str:
    """SQL of a file's one-line summary, null without symbols."""
    names = f"array_join(transform(slice({symbols}, 1, 5), s -> coalesce(s.name, '')), ', ')"
    return f"if(size({symbols}) > 0, concat('Defines: ', {names}, if(size({symbols}) > 5, ', ...', '')), null)"


def words_of(query: str) -> list[str]:
    """A query's words."""
    return python_tokenize(query)


def lexical(files: DataFrame, query: str) -> DataFrame:
    """``repo, path, lexical`` of every file."""
    return files.select("repo", "path", lexical_score(words_of(query)).alias("lexical"))
