"""Symbols and references of source text in six languages, by error-tolerant scanners.

Comments and the insides of strings are blanked first, so that positions stay and words in them
don't count. Python is read by lines and indentation, the brace languages by declarations and the
nesting of braces. Damaged text still yields what can be told.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

MAX_SIGNATURE = 200


@dataclass(frozen=True)
class Found:
    """A symbol or a reference at an offset."""

    at: int
    name: str
    kind: str
    signature: str = ""
    parent: str | None = None
    end: int = 0


_C_STRINGS = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_BLANK = {
    "python": re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)+'", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?(?:\"\1|\Z)|b?\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\\n]|\\[^\n]{1,9})'", re.S),
    "java": re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|" + _C_STRINGS, re.S),
    "typescript": re.compile(r"`(?:[^`\\]|\\.)*`?|(?<=[(,=:\[!&|?;])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|" + _C_STRINGS, re.S),
}
_BLANK["javascript"] = _BLANK["typescript"]


def blank(text: str, language: str) -> str:
    """The text with comments and strings blanked, quotes kept, line breaks kept."""

    def out(m: re.Match) -> str:
        s = m.group()
        keep = s[0] if s[0] in "\"'`" and len(s) > 1 and s[-1] == s[0] else ""
        # A Python string over several lines is one piece of its logical line, so its breaks go as well.
        inner = " " * len(s) if keep and language == "python" else re.sub(r"[^\n]", " ", s)
        return keep + inner[1:-1] + keep if keep else inner

    return _BLANK[language].sub(out, text)


def signature_of(text: str, start: int, end: int) -> str:
    """First line of a declaration without its opening brace or colon, at most 200 characters."""
    line = text[start:end].split("\n", 1)[0].rstrip().rstrip(":{").rstrip()
    return line if len(line) <= MAX_SIGNATURE else line[: MAX_SIGNATURE - 3] + "..."


def close_of(bare: str, start: int) -> int:
    """The offset behind the brace that closes the first one from ``start`` on; the text's end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(bare, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(bare.rstrip()) or len(bare)


def _statement_end(bare: str, start: int) -> int:
    """The end of a logical line: its line break outside of brackets."""
    depth = 0
    for m in re.compile(r"[\[({\])}\n]").finditer(bare, start):
        c = m.group()
        if c == "\n":
            if depth <= 0:
                return m.start()
        else:
            depth += 1 if c in "[({" else -1
    return len(bare)


def _python(text: str, bare: str) -> tuple[list[Found], list[Found]]:
    symbols, refs = [], []
    lines: list[tuple[int, int, int]] = []  # offset, indent, end of logical line
    at = 0
    while at < len(bare):
        end = _statement_end(bare, at)
        body = bare[at:end]
        if body.strip():
            lines.append((at, len(text[at:end]) - len(text[at:end].lstrip(" \t")), end))
        at = end + 1

    def block_end(i: int) -> int:
        last = lines[i][2]
        for _, indent, end in lines[i + 1 :]:
            if indent <= lines[i][1]:
                break
            last = end
        return len(text[:last].rstrip())

    scopes: list[tuple[int, str, str]] = []  # indent, kind, name
    decorated = False
    for i, (at, indent, end) in enumerate(lines):
        body = bare[at:end]
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        s = at + indent
        if m := re.match(r"\s*(async\s+)?def\s+(\w+)", body):
            method = bool(scopes) and scopes[-1][1] == "class" and not decorated
            parent = next((n for _, k, n in reversed(scopes) if k == "class"), None) if method else None
            symbols.append(Found(s, m.group(2), "method" if method else "function", signature_of(text, s, end), parent, block_end(i)))
            scopes.append((indent, "def", m.group(2)))
        elif m := re.match(r"\s*class\s+(\w+)\s*(?:\((.*)\))?", body, re.S):
            symbols.append(Found(s, m.group(1), "class", signature_of(text, s, end), None, block_end(i)))
            for b in re.finditer(r"(?:^|,)\s*([A-Za-z_]\w*)\s*(?=,|$)", m.group(2) or ""):
                refs.append(Found(at + m.start(2) + b.start(1), b.group(1), "inherits"))
            scopes.append((indent, "class", m.group(1)))
        elif m := re.match(r"\s*import\s+(.+)", body, re.S):
            for b in re.finditer(r"(?:^|,)\s*([\w.]+)\s*(?=,|$)", m.group(1).rstrip()):
                refs.append(Found(at + m.start(1) + b.start(1), b.group(1), "imports"))
        elif m := re.match(r"\s*from\s+(\.*\s*[\w.]*)\s+import\b", body):
            name = re.sub(r"\s", "", m.group(1))
            if name and name != "__future__":
                refs.append(Found(at + m.start(1), name, "imports"))
        elif indent == 0 and (m := re.match(r"([A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)", body)):
            symbols.append(Found(s, m.group(1), "variable", signature_of(text, s, end), None, end))
        decorated = bool(re.match(r"\s*@", body))
    return symbols, refs


_TS_WORDS = r"(?:if|for|while|switch|catch|function|return|new|throw|else|do|typeof|await|with|super|import)\b"
_MEMBER = re.compile(
    rf"(?:(?<=[;{{}}])|^)[ \t\n\r]*((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|\*)\s*\b)*(?!{_TS_WORDS})([A-Za-z_$#][\w$]*)\s*(?:<[^(){{}}]*>)?\()", re.M
)


def _after_parens(bare: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[()]").finditer(bare, at):
        depth += 1 if m.group() == "(" else -1
        if depth == 0:
            return m.end()
    return -1


def _script(text: str, bare: str, typed: bool) -> tuple[list[Found], list[Found]]:
    symbols, refs = [], []
    for m in re.finditer(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\(", bare):
        symbols.append(Found(m.start(), m.group(1), "function", signature_of(text, m.start(), len(text)), None, close_of(bare, max(m.end(), _after_parens(bare, m.end() - 1)))))
    for m in re.finditer(r"\b(?:const|let|var)\s+(([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+?)?=\s*(?:async\s*)?(?:<[^(){}]*>\s*)?(?:(\()|[A-Za-z_$][\w$]*\s*=>))", bare):
        if m.group(3):
            past = _after_parens(bare, m.end() - 1)
            arrow = re.compile(r"\s*(?::[^={};]+)?=>").match(bare, past) if past > 0 else None
            if not arrow:
                continue
            past = arrow.end()
        else:
            past = m.end()
        brace = re.compile(r"\s*\{").match(bare, past)
        symbols.append(Found(m.start(1), m.group(2), "function", signature_of(text, m.start(1), len(text)), None, close_of(bare, past) if brace else _statement_end(bare, past)))
    classes = []
    for m in re.finditer(r"\b(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)\s*(?:<[^{}]*?>)?\s*([^{]*)\{", bare):
        end = close_of(bare, m.end() - 1)
        classes.append((m.end(), end, m.group(1)))
        symbols.append(Found(m.start(), m.group(1), "class", signature_of(text, m.start(), len(text)), None, end))
        if e := re.search(r"\bextends\s+([A-Za-z_$][\w$]*)\s*(?=\{|implements\b|$)", m.group(2)):
            refs.append(Found(m.start(2) + e.start(1), e.group(1), "inherits"))
        if typed and (e := re.search(r"\bimplements\s+(.*)$", m.group(2), re.S)):
            for b in re.finditer(r"(?:^|,)\s*([A-Za-z_$][\w$]*)\s*(?=,|$)", e.group(1)):
                refs.append(Found(m.start(2) + e.start(1) + b.start(1), b.group(1), "implements"))
    head = re.compile(r"\s*(?::\s*\{[^{}]*\}\s*|:[^;{}]*)?\{")
    for start, end, name in classes:
        at = start
        while m := _MEMBER.search(bare, at, end):
            past = _after_parens(bare, m.end() - 1)
            body = head.match(bare, past) if past > 0 else None
            level = bare.count("{", at, m.start(1)) - bare.count("}", at, m.start(1))
            if body and level == 0:
                at = close_of(bare, body.end() - 1)
                symbols.append(Found(m.start(1), m.group(2), "method", signature_of(text, m.start(1), len(text)), name, at))
                at = min(max(at - 1, m.end()), end)  # the closing brace may stand before the next member
                at += bare[at : at + 1] == "}"
            else:  # a field, a nested block or a declaration without body
                brace = bare.find("{", m.start(1), end) if level == 0 else -1
                semi = bare.find(";", m.start(1), end)
                at = close_of(bare, brace) if brace >= 0 and not 0 <= semi < brace else m.end()
    for m in re.finditer(r"^\s*import\b[^'\"`;]*(['\"])", bare, re.M):
        close = text.find(m.group(1), m.end())
        if close > 0:
            refs.append(Found(m.end() - 1, text[m.end() : close], "imports"))
    if typed:
        for kind, pattern in (("interface", r"\binterface\s+([A-Za-z_$][\w$]*)[^{;=]*\{"), ("enum", r"\benum\s+([A-Za-z_$][\w$]*)\s*\{")):
            for m in re.finditer(pattern, bare):
                symbols.append(Found(m.start(), m.group(1), kind, signature_of(text, m.start(), len(text)), None, close_of(bare, m.end() - 1)))
        for m in re.finditer(r"(?:^|[;{}\s])(type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=;]*>)?\s*=)", bare):
            symbols.append(Found(m.start(1), m.group(2), "type", signature_of(text, m.start(1), len(text)), None, max(_statement_end(bare, m.end()), m.end())))
    return symbols, refs


def _go(text: str, bare: str) -> tuple[list[Found], list[Found]]:
    symbols, refs = [], []
    for m in re.finditer(r"^func\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(", bare, re.M):
        symbols.append(Found(m.start(), m.group(2), "method" if m.group(1) else "function", signature_of(text, m.start(), len(text)), None, close_of(bare, max(m.end(), _after_parens(bare, m.end() - 1)))))
    blocks = [(m.end(), bare.find("\n)", m.end())) for m in re.finditer(r"^type\s*\(", bare, re.M)]
    for m in re.finditer(r"^(?:type\s+|[ \t]+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?=?\s*([^\s(=][^\n]*)", bare, re.M):
        if m.group().startswith("type") or any(a <= m.start() < b for a, b in blocks):
            brace = m.group(2).rstrip().endswith("{")
            symbols.append(Found(m.start(1), m.group(1), "type", signature_of(text, m.start(1), len(text)), None, close_of(bare, m.end() - 1) if brace else m.end()))
    for m in re.finditer(r"^import\s*(\(|[^\n]*)", bare, re.M):
        end = bare.find(")", m.end()) if m.group(1).startswith("(") else m.end()
        for b in re.finditer(r"\"([^\"\n]*)\"", text[m.start() : end if end > 0 else len(text)]):
            refs.append(Found(m.start() + b.start(), b.group(1), "imports"))
    return symbols, refs


def _rust(text: str, bare: str) -> tuple[list[Found], list[Found]]:
    symbols, refs = [], []
    impls = []
    for m in re.finditer(r"\bimpl\b\s*(<[^{]*?>\s*)?([^{;]*)\{", bare):
        head = re.match(r"([A-Za-z_]\w*)(?=\s|$)", m.group(2).strip())
        impls.append((m.end(), close_of(bare, m.end() - 1), head.group(1) if head else None))
    for m in re.finditer(r"\b((?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+([A-Za-z_]\w*))", bare):
        body = re.compile(r"[{;]").search(bare, max(m.end(), _after_parens(bare, m.end())))
        if not body or body.group() == ";":  # a signature without body defines nothing
            continue
        impl = next(((a, b, n) for a, b, n in impls if a <= m.start() < b and bare.count("{", a, m.start()) == bare.count("}", a, m.start())), None)
        symbols.append(Found(m.start(1), m.group(2), "method" if impl else "function", signature_of(text, m.start(1), len(text)), impl[2] if impl else None, close_of(bare, body.start())))
    for kind, word in (("class", "struct"), ("enum", "enum"), ("interface", "trait"), ("type", "type")):
        for m in re.finditer(rf"^[ \t]*((?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{word}\s+([A-Za-z_]\w*))[^{{;]*([{{;])", bare, re.M):
            if kind == "type" and any(a <= m.start() < b for a, b, _ in impls):
                continue
            end = close_of(bare, m.end() - 1) if m.group(3) == "{" else m.end()
            symbols.append(Found(m.start(1), m.group(2), kind, signature_of(text, m.start(1), len(text)), None, end))
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+?)\s*;", bare, re.M):
        refs.append(Found(m.start(1), m.group(1), "imports"))
    return symbols, refs


_JAVA_TYPE = r"[A-Za-z_$][\w$.]*(?:<[^(){};=]*>)?(?:\[\])*"
_JAVA_MODS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+|@[\w.]+(?:\([^()]*\))?\s*)*"


def _java(text: str, bare: str) -> tuple[list[Found], list[Found]]:
    symbols, refs, classes = [], [], []
    for m in re.finditer(rf"({_JAVA_MODS}\b(class|interface|enum)\s+([A-Za-z_$][\w$]*))([^{{;]*)\{{", bare):
        kind, end = m.group(2), close_of(bare, m.end() - 1)
        start = m.start(1)
        symbols.append(Found(start, m.group(3), kind, signature_of(text, start, len(text)), None, end))
        if kind == "class":
            classes.append((m.end(), end, m.group(3)))
        if kind == "class" and (e := re.search(r"\bextends\s+([A-Za-z_$][\w$]*)\s*(?=implements\b|permits\b|$)", m.group(4).rstrip() + " ")):
            refs.append(Found(m.start(4) + e.start(1), e.group(1), "inherits"))
        if kind == "class" and (e := re.search(r"\bimplements\s+(.*?)(?:\bpermits\b|$)", m.group(4), re.S)):
            for b in re.finditer(r"(?:^|,)\s*([A-Za-z_$][\w$]*)\s*(?=,|$)", e.group(1)):
                refs.append(Found(m.start(4) + e.start(1) + b.start(1), b.group(1), "implements"))
    for m in re.finditer(rf"(?:(?<=[;{{}}])|^)\s*({_JAVA_MODS}(?:<[^(){{}};]*>\s*)?(?!(?:return|new|throw|else|if|for|while|switch|case|package|import|assert|yield)\b)(?:({_JAVA_TYPE})\s+)?([A-Za-z_$][\w$]*)\s*\()", bare, re.M):
        past = _after_parens(bare, m.end() - 1)
        body = re.compile(r"\s*(?:throws\s+[^{;]*)?([{;])").match(bare, past) if past > 0 else None
        owner = next((c for c in sorted(classes, key=lambda c: -c[0]) if c[0] <= m.start(1) < c[1]), None)
        if not body or m.group(3) in ("if", "for", "while", "switch", "catch", "synchronized", "try", "return", "super", "this") or (not m.group(2) and (not owner or owner[2] != m.group(3))):
            continue
        if bare[: m.start(1)].count("{") - bare[: m.start(1)].count("}") < 1 or (m.group(2) and body.group(1) == ";" and owner and bare.count("{", owner[0], m.start(1)) != bare.count("}", owner[0], m.start(1))):
            continue
        symbols.append(Found(m.start(1), m.group(3), "method", signature_of(text, m.start(1), len(text)), owner[2] if owner else None, close_of(bare, past) if body.group(1) == "{" else body.end()))
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", bare, re.M):
        refs.append(Found(m.start(1), m.group(1), "imports"))
    return symbols, refs


def reader(language: str) -> Callable:
    """The scanner of a language; ``ValueError`` for one that is not supported."""
    readers = {"python": _python, "go": _go, "rust": _rust, "java": _java, "typescript": partial(_script, typed=True), "javascript": partial(_script, typed=False)}
    if language not in readers:
        raise ValueError(f"unsupported language: {language}")
    return readers[language]


def scan(text: str, language: str, path: str) -> tuple[list[dict], list[dict]]:
    """Symbols and references of a text as rows of the index; empty for languages not known.

    Of a function and a method on one line only the method stays. Order is by position.
    """
    if language not in _BLANK or not text:
        return [], []
    symbols, refs = reader(language)(text, blank(text, language))
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    methods = {line(s.at) for s in symbols if s.kind == "method"}
    kept = sorted((s for s in symbols if not (s.kind == "function" and line(s.at) in methods)), key=lambda s: (s.at, s.kind))
    out = [
        {"name": s.name, "kind": s.kind, "file": path, "line": line(s.at), "signature": s.signature, "parent": s.parent, "end_line": line(max(s.at, s.end - 1)), "ord": i}
        for i, s in enumerate(kept)
    ]
    found = [
        {"source_file": path, "target_name": r.name, "target_file": None, "line": line(r.at), "kind": r.kind, "ord": i} for i, r in enumerate(sorted(refs, key=lambda r: (r.at, r.kind)))
    ]
    return out, found


#: The import patterns of text that is only searched, by language, in the order they are tried.
IMPORT_PATTERNS = {
    "python": (r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"),
    "typescript": (r"""^\s*import\s+.*?from\s+['"]([^'"]+)['"]""",),
    "javascript": (r"""^\s*import\s+.*?from\s+['"]([^'"]+)['"]""", r"""^\s*(?:const|let|var)\s+.*?=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
    "go": (r"""^\s*"([^"]+)"\s*$""",),
    "rust": (r"^\s*use\s+([\w:]+)",),
    "java": (r"^\s*import\s+([\w.]+)",),
}


def search_imports(text: str, language: str) -> list[tuple[str, int]]:
    """Import targets by patterns alone, pattern by pattern, with the line each match begins on (blank lines before it belong to it)."""
    return [(m.group(1), text.count("\n", 0, m.start()) + 1) for p in IMPORT_PATTERNS.get(language, ()) for m in re.finditer(p, text, re.M)]
