"""Lexers of the six languages and the judgement of whole files.

A lexer is one compiled expression that cuts the whole text, and a table from lexemes to token kinds
that fills as lexemes are first met. What is left over becomes a token of no kind, which no grammar
accepts, so a file is valid only if all of it is consumed.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache

from . import grammars as g
from .peg import BRACE, END, ERR, INDENT, MARKUP, PAREN, SQUARE, TEMPLATE, Grammar, Kinds

TABLE = 300_000  # lexemes kept
MOST_FRAMES = 1_000_000  # of the grammar's recursion; some 200 MB


def _ops(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


class Lexemes(dict):
    """Kinds by lexeme."""

    def __init__(self, classify: Callable[[str], int], empty: int):
        super().__init__()
        self.classify, self.empty = classify, empty  # the end of the text is an empty lexeme

    def __missing__(self, lexeme: str) -> int:
        kind = self.classify(lexeme) if lexeme else self.empty
        if len(lexeme) <= 80:
            if len(self) >= TABLE:
                self.clear()
            self[lexeme] = kind
        return kind


class Unbalanced(Exception):
    """A bracket or indentation that fits no other; ``at`` is its plain token."""

    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


class _Illegal(Exception):
    """The exact reader meets what is no token; its argument is the place."""


class Language:
    """Common parts: brackets become groups, and a grammar judges the tree."""

    start = "File"
    breaks = False  # whether line breaks before tokens matter

    def __init__(self, grammar: str, reserved: list[str], contextual: list[str], ops: list[str], classes: dict[str, set[str]]):
        self.kinds = Kinds()
        self.reserved, self.contextual, self.ops = set(reserved), set(contextual), set(ops)
        named = {"Id": {"ID", *contextual}, "WORD": {"ID", *contextual, *reserved}} | classes
        self.grammar = Grammar(grammar, self.kinds, named)
        self.NL, self.ID = self.kinds["NL"], self.kinds["ID"]
        k = self.kinds
        self.opens = {k["("]: PAREN, k["["]: SQUARE, k["{"]: BRACE}
        self.closes = {k[")"]: PAREN, k["]"]: SQUARE, k["}"]: BRACE}
        self.lexemes = Lexemes(self.classify, self.NL)
        self.word_kinds = {w: k[w] for w in [*contextual, *reserved]}
        self.op_kinds = {w: k[w] for w in ops}
        self.pattern: re.Pattern = self.make_pattern()

    def make_pattern(self) -> re.Pattern:
        raise NotImplementedError

    def classify(self, lexeme: str) -> int:
        raise NotImplementedError

    def word(self, lexeme: str) -> int:
        return self.word_kinds.get(lexeme, self.ID)

    def kinds_of(self, text: str) -> list[int]:
        return list(map(self.lexemes.__getitem__, self.pattern.findall(text)))

    def tree(self, kinds: list[int]) -> list[int]:
        """Tokens with brackets grouped; ``Unbalanced`` where they do not match."""
        opens, closes, group = self.opens, self.closes, self.grammar.group
        nl, breaks = self.NL, self.breaks
        stack: list[tuple] = []
        cur: list[int] = []
        flag = 0
        at = 0
        for k in kinds:
            if k == nl:
                flag = 1 if breaks else 0
                continue
            if k in opens:
                stack.append((cur, opens[k], flag, at))
                cur = []
            elif k in closes:
                if not stack or stack[-1][1] != closes[k]:
                    raise Unbalanced(at, "unbalanced bracket")
                inside = cur
                cur, kind, flag, _ = stack.pop()
                cur.append(group(kind, inside) << 1 | flag)
            else:
                cur.append(k << 1 | flag)
            flag = 0
            at += 1
        if stack:
            raise Unbalanced(at, "unclosed bracket")
        return cur

    def positions(self, text: str) -> list[int]:
        """Offsets of the plain tokens in the text, for reports."""
        return [m.start(1) for m in self.pattern.finditer(text) if self.lexemes[m.group(1)] != self.NL]

    def prepare(self, text: str) -> str:
        return text

    def exactly(self, text: str, markup: bool) -> tuple[list[int], list[int]] | None:
        """Kinds and places of the tokens by a reader that knows no bounds, for what the one expression cannot tell; none where it can."""
        return None

    def _accepts(self, kinds: list[int]) -> bool | None:
        """Whether the tokens are valid, none if that takes too deep a recursion."""
        if ERR in kinds:
            return False
        limit = sys.getrecursionlimit()
        try:
            return self.grammar.accepts(self.start, self.tree(kinds))
        except Unbalanced:
            return False
        except RecursionError:
            if limit >= MOST_FRAMES:
                return None
        finally:
            self.grammar.tidy()
        # Chains like else-if or a ? b : c ? d recurse in the grammar; Python's own frames take memory only.
        try:
            sys.setrecursionlimit(MOST_FRAMES)
            return self.grammar.accepts(self.start, self.tree(kinds))
        except RecursionError:
            self.grammar.clear()
            return None
        finally:
            sys.setrecursionlimit(limit)

    def valid(self, text: str, markup: bool = False) -> bool | None:
        """Whether the whole text is valid; none where it is nested too deeply to be judged. ``markup`` admits JSX elements."""
        self.grammar.tidy()
        prepared = self.prepare(text)
        got = self._accepts(self.kinds_of(prepared))
        if got is False and (exact := self.exactly(prepared, markup)):
            return self._accepts(exact[0])
        return got

    def check(self, text: str, markup: bool = False) -> tuple[bool | None, int, str]:
        """Whether the whole text is valid; else the offset of the furthest failure and the cause."""
        valid = self.valid(text, markup)
        if valid:
            return True, -1, ""
        prepared = self.prepare(text)
        exact = self.exactly(prepared, markup)
        kinds, places = exact or (self.kinds_of(prepared), self.positions(prepared))
        at, cause = (0, "nested too deeply to judge") if valid is None else self._failure(prepared, kinds, places)
        # What is prepared differs from the text at its beginning only.
        return valid, min(len(text), max(0, at - len(prepared) + len(text))), cause

    def _failure(self, text: str, kinds: list[int], places: list[int]) -> tuple[int, str]:
        def place(at: int) -> int:
            return places[at] if at < len(places) else len(text)

        if ERR in kinds:
            return place([k for k in kinds if k != self.NL].index(ERR)), "illegal or unterminated token"
        try:
            tree = self.tree(kinds)
        except Unbalanced as e:
            return place(e.at), e.why
        try:
            at, wanted = self.grammar.furthest(self.start, tree)
        except RecursionError:
            return 0, "unexpected token, nested too deeply to place"
        offset = place(at)
        if offset >= len(text.rstrip()):
            return offset, "truncated"
        return offset, "unexpected token" + (f", wanted {' '.join(wanted[:4])}" if wanted and len(wanted) <= 4 else "")

    def accepts_expression(self, rule: str, text: str) -> bool:
        kinds = self.kinds_of(text)
        if ERR in kinds:
            return False
        try:
            tree = self.tree(kinds)
        except Unbalanced:
            return False
        if tree and tree[-1] >> 1 == self.NL:
            tree.pop()
        return self.grammar.accepts(rule, tree)


_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+\*/"
_NAME = r"[^\W\d]\w*"


class Java(Language):
    def __init__(self) -> None:
        super().__init__(g.JAVA, g.JAVA_RESERVED, g.JAVA_CONTEXTUAL, g.JAVA_OPS, {})

    def make_pattern(self) -> re.Pattern:
        skip = rf"(?:[ \t\r\n\f]+|{_LINE_COMMENT}|{_BLOCK_COMMENT})*+"
        text_block = r'"""[ \t\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
        number = r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*"
        return re.compile(rf"{skip}([A-Za-z_$\u0080-\U0010ffff][\w$]*|{text_block}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{{4}}|[0-7]{{1,3}}|.))'|{number}|/\*|{_ops(g.JAVA_OPS)}|[^ \t\r\n\f]|\Z)")

    _NUMBER = re.compile(r"(?:0[xX][\da-fA-F](?:_*[\da-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|\d(?:_*\d)*[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[fFdD]?|0[xX][\da-fA-F_.]+[pP][+-]?\d+[fFdD]?)")
    _ESCAPE = re.compile(r"\\(?![btnfrs\"'\\0-7u\n])")

    def classify(self, x: str) -> int:
        c = x[0]
        if x in ("true", "false", "null"):
            return self.kinds["LIT"]
        if c.isalpha() or c in "_$" or c > "\x7f":
            return self.word(x) if x.replace("$", "_").isidentifier() else ERR
        if c.isdigit() or (c == "." and len(x) > 1 and x[1].isdigit()):
            if re.fullmatch(r"0[0-7_]*[89][\d_]*[lL]?", x):
                return ERR
            return self.kinds["LIT"] if self._NUMBER.fullmatch(x) else ERR
        if c in "\"'":
            return self.kinds["LIT"] if len(x) > 1 and not self._ESCAPE.search(x) else ERR
        return self.op_kinds.get(x, ERR)


class Go(Language):
    def __init__(self) -> None:
        super().__init__(g.GO, g.GO_RESERVED, [], g.GO_OPS, {})
        self.SEMI = self.kinds[";"]
        self.ends = {self.kinds[x] for x in g.GO_ENDS}

    def make_pattern(self) -> re.Pattern:
        skip = rf"(?:[ \t\r]+|{_LINE_COMMENT}|/\*(?:[^*\n]|\*(?!/))*+\*/)*+"
        number = r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*"
        rune = r"'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[abfnrtv\\']))'"
        return re.compile(rf"{skip}({_NAME}|\n\s*|{_BLOCK_COMMENT}|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|{rune}|{number}|/\*|{_ops(g.GO_OPS)}|[^ \t\r\n]|\Z)")

    _NUMBER = re.compile(r"(?:0[xX]_?[\da-fA-F](?:_?[\da-fA-F])*|0[bB]_?[01](?:_?[01])*|0[oO]?_?[0-7](?:_?[0-7])*|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?|0[xX][\da-fA-F_.]+[pP][+-]?\d+)i?")
    _ESCAPE = re.compile(r"\\(?:\\|([^\\]))")

    def classify(self, x: str) -> int:
        c = x[0]
        if c == "\n" or x.startswith("/*") and len(x) > 3:
            return self.NL
        if c.isalpha() or c == "_":
            return self.word(x)
        if c.isdigit() or (c == "." and len(x) > 1 and x[1].isdigit()):
            return self.kinds["LIT"] if self._NUMBER.fullmatch(x) else ERR
        if c == '"' and len(x) > 1:
            return self.kinds["STR"] if all((m.group(1) or "\\") in 'abfnrtv"\\xuU01234567' for m in self._ESCAPE.finditer(x)) else ERR
        if c == "`" and len(x) > 1:
            return self.kinds["STR"]
        if c == "'" and len(x) > 1:
            return self.kinds["LIT"]
        return self.op_kinds.get(x, ERR)

    def kinds_of(self, text: str) -> list[int]:
        # A line break after a token that can end a statement is a semicolon.
        out: list[int] = []
        nl, semi, ends, closes = self.NL, self.SEMI, self.ends, self.closes
        last = END
        for k in super().kinds_of(text):
            if k == nl:
                if last in ends or last in closes:
                    out.append(semi)
                    last = semi
            else:
                out.append(k)
                last = k
        if last in ends or last in closes:
            out.append(semi)
        return out

    def positions(self, text: str) -> list[int]:
        out, last = [], END
        for m in self.pattern.finditer(text):
            k = self.lexemes[m.group(1)]
            if k != self.NL:
                out.append(m.start(1))
                last = k
            elif last in self.ends or last in self.closes:
                out.append(m.start(1))
                last = self.SEMI
        return out


class Rust(Language):
    def __init__(self) -> None:
        super().__init__(g.RUST, g.RUST_RESERVED, g.RUST_CONTEXTUAL, g.RUST_OPS, {})

    def make_pattern(self) -> re.Pattern:
        flat = r"(?:[^*/]|\*(?!/)|/(?!\*))*"
        nested = flat
        for _ in range(3):  # block comments nest
            nested = rf"(?:[^*/]|\*(?!/)|/(?!\*)|/\*{nested}\*/)*"
        skip = rf"(?:[ \t\r\n\f]+|{_LINE_COMMENT}|/\*{nested}\*/)*+"
        char = r"b?'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}|[nrt\\0'\"]))'"
        number = r"\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?\w*|0x[\da-fA-F_]+\w*"
        raws = "|".join(rf'(?:br|cr|r){"#" * n}"(?:[^"]|"(?!{"#" * n}))*"{"#" * n}' if n else r'(?:br|cr|r)"[^"]*"' for n in range(4))
        return re.compile(rf"{skip}({raws}|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|{char}|'{_NAME}(?!')|(?:r#)?{_NAME}|{number}|/\*|{_ops(g.RUST_OPS)}|[^ \t\r\n\f]|\Z)")

    _NUMBER = re.compile(r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*)(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.\d[\d_]*|\.)?(?:[eE][+-]?[\d_]+)?(?:f32|f64)?")

    def classify(self, x: str) -> int:
        c = x[0]
        if x in ("true", "false"):
            return self.kinds["LIT"]
        if x[-1] == '"' and len(x) > 1 or c == '"':
            return self.kinds["STR"] if len(x) > 1 else ERR
        if x[-1] == "'" and len(x) > 2:
            return self.kinds["LIT"]
        if c == "'":
            return self.kinds["LIFE"] if len(x) > 1 else ERR
        if x[-1] == "#" and len(x) > 1 or '"' in x:
            return self.kinds["STR"]
        if c.isalpha() or c == "_":
            return self.ID if x.startswith("r#") else self.word(x)
        if c.isdigit():
            return self.kinds["LIT"] if self._NUMBER.fullmatch(x) else ERR
        return self.op_kinds.get(x, ERR)

    _PARTS = re.compile(r"//[^\n]*|(/\*)|(?:br|cr|r)(#+)\"|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n']+|\\')'")
    _COMMENT = re.compile(r"/\*|\*/")

    def exactly(self, text: str, markup: bool) -> tuple[list[int], list[int]] | None:
        """Comments nested and raw strings fenced to any depth are blanked out, place for place."""
        if "/*" not in text and '#"' not in text:
            return None
        out, at = [], 0
        while m := self._PARTS.search(text, at):
            out.append(text[at : m.start()])
            end = m.end()
            if m.group(1):
                depth = 0
                for c in self._COMMENT.finditer(text, m.start()):
                    depth += 1 if c.group() == "/*" else -1
                    if not depth:
                        break
                if depth:
                    return None
                end = c.end()
                out.append(re.sub(r"[^\n]", " ", text[m.start() : end]))
            elif m.group(2):
                end = text.find('"' + m.group(2), end)
                if end < 0:
                    return None
                end += 1 + len(m.group(2))
                out.append('""' + re.sub(r"[^\n]", " ", text[m.start() + 2 : end]))
            else:
                out.append(m.group())
            at = end
        plain = "".join([*out, text[at:]])
        return self.kinds_of(plain), self.positions(plain)

    def prepare(self, text: str) -> str:
        return text[text.find("\n") if "\n" in text else len(text) :] if text.startswith("#!") and not text[2:].lstrip().startswith("[") else text


class Script(Language):
    """JavaScript as a module, and TypeScript."""

    start = "Module"
    breaks = True

    def __init__(self, typed: bool):
        contextual = g.JS_CONTEXTUAL + (g.TS_CONTEXTUAL if typed else [])
        super().__init__(g.TYPESCRIPT if typed else g.JAVASCRIPT, g.JS_RESERVED, contextual, g.JS_OPS, {})
        self.typed = typed
        k = self.kinds
        self.BRACES = k["{"], k["}"]
        self.TEMPLATE = k["template"], k["template end"]
        self.MARKUP = k["element"], k["element end"]
        self.opens |= {self.TEMPLATE[0]: TEMPLATE, self.MARKUP[0]: MARKUP}
        self.closes |= {self.TEMPLATE[1]: TEMPLATE, self.MARKUP[1]: MARKUP}
        self.pairs: list[tuple[int, ...]] = []  # what lexemes of several tokens stand for
        self.step = self.make_step()

    _REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
    _BEFORE = r"=>|&&|\|\||\?\?|===?|!==?|[-+*%<>&|^~!=(,:\[?{};]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield)"

    def make_pattern(self) -> re.Pattern:
        skip = rf"(?:[ \t\r\f\v\u00a0\ufeff]+|{_LINE_COMMENT}|/\*(?:[^*\n]|\*(?!/))*+\*/)*+"
        number = r"(?:0[xX][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[\w$]*"
        string = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
        plain = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
        inner = rf"(?:[^{{}}`\"']|{string}|{plain}|\{{(?:[^{{}}`\"']|{string}|{plain}|\{{[^{{}}`]*\}})*\}})*"
        once = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{inner}\}})*`"
        inner2 = rf"(?:[^{{}}`\"']|{string}|{once}|\{{(?:[^{{}}`\"']|{string}|{once}|\{{[^{{}}`]*\}})*\}})*"
        template = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{inner2}\}})*`"
        name = r"(?:[A-Za-z_$\u0080-\u009f\u00a1-\ufefe\uff00-\U0010ffff]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*"
        return re.compile(
            rf"{skip}((?:{self._BEFORE})\s*{self._REGEX}|{name}|\n\s*|{_BLOCK_COMMENT}|{string}|{template}|{number}|/\*|#{name}|{_ops(g.JS_OPS)}|[^ \t\r\f\v\n\u00a0\ufeff]|\Z)"
        )

    _NUMBER = re.compile(r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|0|[1-9](?:_?\d)*)n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?")
    _PAIR = re.compile(rf"({_BEFORE})\s*(/.*)", re.S)

    def classify(self, x: str) -> int:
        c = x[0]
        if c == "\n" or x.startswith("/*") and len(x) > 3:
            return self.NL
        if x in self.op_kinds:
            return self.op_kinds[x]
        if c == "#" and len(x) > 1:
            return self.kinds["PRIV"]
        if c in "\"'":
            return self.kinds["STR"] if len(x) > 1 and x[-1] == c and not re.search(r"\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4}|\{))", x) else ERR
        if c == "`":
            if len(x) == 1:
                return ERR
            inner = [k for e in self.substitutions(x) for k in (self.BRACES[0], *self.kinds_of(e), self.BRACES[1])]
            return self._several((self.TEMPLATE[0], *inner, self.TEMPLATE[1]))
        if c.isdigit() or (c == "." and len(x) > 1 and x[1].isdigit()):
            return self.kinds["NUM"] if self._NUMBER.fullmatch(x) else ERR
        if x[-1] != "\\" and "/" in x and (m := self._PAIR.fullmatch(x)):
            flags = x[x.rindex("/") + 1 :]
            if set(flags) - set("dgimsuvy") or len(set(flags)) != len(flags) or not _regex_ok(x[x.index("/") :]):
                return ERR
            return self._several((self.lexemes[m.group(1)], self.kinds["REGEX"]))
        if c.isalpha() or c in "_$\\" or c > "\x7f":
            return self.word(x) if c == "\\" or x.replace("$", "_").replace("\\", "_").replace("{", "_").replace("}", "_").isidentifier() else ERR
        return ERR

    def _several(self, kinds: tuple[int, ...]) -> int:
        self.pairs.append(kinds)
        return -len(self.pairs)

    @staticmethod
    def substitutions(template: str) -> list[str]:
        """The expressions in a template's ``${}``."""
        out, i, depth, start = [], 1, 0, 0
        quote = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`")
        while i < len(template) - 1:
            c = template[i]
            if depth == 0:
                if c == "\\":
                    i += 1
                elif template.startswith("${", i):
                    depth, i = 1, i + 1
                    start = i + 1
            elif c in "\"'`" and (m := quote.match(template, i)):
                i = m.end() - 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    out.append(template[start:i])
            i += 1
        return out

    def kinds_of(self, text: str) -> list[int]:
        kinds = super().kinds_of(text)
        if kinds and min(kinds) < 0:
            kinds = [k for x in kinds for k in (self.pairs[-x - 1] if x < 0 else (x,))]
        return kinds

    def positions(self, text: str) -> list[int]:
        out = []
        for m in self.pattern.finditer(text):
            k = self.lexemes[m.group(1)]
            if k < 0:
                several = self.pairs[-k - 1]
                at = m.group(1).index("/") if several[-1] == self.kinds["REGEX"] else 0
                out += [m.start(1), *[m.start(1) + at] * (sum(x != self.NL for x in several) - 1)]
            elif k != self.NL:
                out.append(m.start(1))
        return out

    def valid(self, text: str, markup: bool = False) -> bool | None:
        if len(self.pairs) > TABLE:
            self.pairs.clear()
            self.lexemes.clear()
        return super().valid(text, markup)

    # The exact reader: a stack in place of bounded expressions, for templates and elements nested to any depth and for
    # regular expressions after brackets, which the one expression takes for divisions.

    _SPACE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*")
    _TAG = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$-]*(?:\s*[.:]\s*[\w$-]+)*")
    _CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
    _LITERAL = re.compile(_REGEX)
    _VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
    _CHILDREN = re.compile(r"[^<{>}]*")
    _GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b)")
    _BEFORE_VALUES = set("return typeof case in of delete void throw new else do await yield instanceof default extends".split())
    _HEADS = {"if", "while", "for", "with"}

    def make_step(self) -> re.Pattern:
        whole = self.pattern.pattern
        # The same tokens without templates and regular expressions.
        start, rest = whole.index(f"((?:{self._BEFORE})"), whole.index("|\\n\\s*|")
        name = whole[whole.index(self._REGEX) + len(self._REGEX) + 1 : rest]
        parts = whole[rest:].split("|`", 1)
        numbers = parts[1][parts[1].index("|(?:0[xX]") :]
        return re.compile(f"{whole[:start]}({name}{parts[0]}{numbers}")

    def exactly(self, text: str, markup: bool) -> tuple[list[int], list[int]] | None:
        kinds: list[int] = []
        places: list[int] = []
        try:
            self._read(text, 0, False, markup, kinds, places)
        except _Illegal as e:
            kinds.append(ERR)
            places.append(e.args[0])
        return kinds, places

    def _put(self, kinds: list[int], places: list[int], kind: int, at: int) -> None:
        kinds.append(kind)
        places.append(at)

    def _read(self, text: str, pos: int, inner: bool, markup: bool, kinds: list[int], places: list[int]) -> int:
        """Tokens up to the end, or with ``inner`` up to the bracket that closes an embedded expression; returns where that is."""
        NL = self.NL
        before: str | None = None  # the token before, or what stands for it: ")" and "}" after which a value may begin are "+"
        dotted = False
        round_: list[bool] = []
        curly: list[bool] = []
        while True:
            m = self.step.match(text, pos)
            x, at, pos = m.group(1), m.start(1), m.end()
            if not x:
                if inner:
                    raise _Illegal(at)
                kinds.append(NL)
                return pos
            value = before is None or before in self._BEFORE_VALUES and not dotted or (before in self.op_kinds and before not in (")", "]", "}", "++", "--"))
            if x[0] == "\n" or x.startswith("/*") and len(x) > 3:
                kinds.append(NL)
                continue
            if x == "`":
                self._put(kinds, places, self.TEMPLATE[0], at)
                while True:
                    pos = self._CHUNK.match(text, pos).end()
                    if text.startswith("`", pos):
                        break
                    if not text.startswith("${", pos):
                        raise _Illegal(at)
                    self._put(kinds, places, self.BRACES[0], pos)
                    pos = self._read(text, pos + 2, True, markup, kinds, places)
                    self._put(kinds, places, self.BRACES[1], pos)
                    pos += 1
                self._put(kinds, places, self.TEMPLATE[1], pos)
                pos += 1
                before, dotted = ")", False
                continue
            if x[0] == "/" and value and (r := self._LITERAL.match(text, at)):
                flags = r.group()[r.group().rindex("/") + 1 :]
                if set(flags) - set("dgimsuvy") or len(set(flags)) != len(flags) or not _regex_ok(r.group()):
                    raise _Illegal(at)
                self._put(kinds, places, self.kinds["REGEX"], at)
                pos = r.end()
                before, dotted = ")", False
                continue
            if x == "<" and markup and value and not (self.typed and self._GENERIC.match(text, at)):
                pos = self._element(text, at, markup, kinds, places)
                before, dotted = ")", False
                continue
            if x == "}" and inner and not curly:
                return at
            kind = self.lexemes[x]
            if kind < 0:
                raise _Illegal(at)
            self._put(kinds, places, kind, at)
            if x == "(":
                round_.append(before in self._HEADS and not dotted)
            elif x == "{":  # a block, or a literal where a value may stand
                curly.append(not value or before in (None, ";", "{", "}", "=>", "else", "do") or before == "+")
            dotted = before in (".", "?.")
            before = x
            if x == ")" and round_ and round_.pop() or x == "}" and curly and curly.pop():
                before = "+"

    def _element(self, text: str, pos: int, markup: bool, kinds: list[int], places: list[int]) -> int:
        """A JSX element from its ``<``: its expressions and inner elements as one group; returns its end."""
        put, space = self._put, self._SPACE
        begin = pos
        put(kinds, places, self.MARKUP[0], begin)

        def embedded(at: int) -> int:
            put(kinds, places, self.BRACES[0], at)
            end = self._read(text, at + 1, True, markup, kinds, places)
            put(kinds, places, self.BRACES[1], end)
            return end + 1

        pos = space.match(text, pos + 1).end()
        m = self._TAG.match(text, pos)
        name = "".join(m.group().split()) if m else ""
        pos = m.end() if m else pos
        while True:
            pos = space.match(text, pos).end()
            if text.startswith("/>", pos) and name:
                put(kinds, places, self.MARKUP[1], pos)
                return pos + 2
            if text.startswith(">", pos):
                pos += 1
                break
            if not name:
                raise _Illegal(begin)
            if text.startswith("{", pos):
                pos = embedded(pos)
                continue
            m = self._TAG.match(text, pos)
            if not m:
                raise _Illegal(pos)
            pos = space.match(text, m.end()).end()
            if text.startswith("=", pos):
                pos = space.match(text, pos + 1).end()
                if text.startswith("{", pos):
                    pos = embedded(pos)
                elif text.startswith("<", pos):
                    pos = self._element(text, pos, markup, kinds, places)
                elif m := self._VALUE.match(text, pos):
                    pos = m.end()
                else:
                    raise _Illegal(pos)
        while True:
            pos = self._CHILDREN.match(text, pos).end()
            if text.startswith("{", pos):
                pos = embedded(pos)
            elif text.startswith("</", pos):
                at = space.match(text, pos + 2).end()
                m = self._TAG.match(text, at)
                at = space.match(text, m.end() if m else at).end()
                if ("".join(m.group().split()) if m else "") != name or not text.startswith(">", at):
                    raise _Illegal(pos)
                put(kinds, places, self.MARKUP[1], pos)
                return at + 1
            elif text.startswith("<", pos):
                pos = self._element(text, pos, markup, kinds, places)
            else:
                raise _Illegal(min(pos, len(text)))

    def prepare(self, text: str) -> str:
        return "//" + text[2:] if text.startswith("#!") else text


def _regex_ok(literal: str) -> bool:
    """Whether the brackets of a regular expression literal match."""
    body = literal[1 : literal.rindex("/")]
    body = re.sub(r"\\.", "x", body)
    body = re.sub(r"\[[^\]]*\]", "x", body)
    depth = 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0 and not re.match(r"[*+?]", body)


class Python(Language):
    def __init__(self) -> None:
        self.indents: dict[int, str] = {}
        self.indent_kinds: dict[str, int] = {}
        super().__init__(g.PYTHON, g.PYTHON_RESERVED, g.PYTHON_CONTEXTUAL, g.PYTHON_OPS, {})

    _PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"

    def make_pattern(self) -> re.Pattern:
        skip = r"[ \t\f]*+(?:\\\n[ \t\f]*)*+"
        line = r"(?:#[^\n]*)?\n(?:[ \t\f]*(?:#[^\n]*)?\n)*[ \t\f]*(?:#[^\n]*\Z)?"
        string = rf"{self._PREFIX}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"\"(?!\")|''(?!'))"
        number = r"(?:0[xX][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)\w*"
        return re.compile(rf"{skip}({line}|{string}|{_NAME}|{number}|#[^\n]*|{_ops(g.PYTHON_OPS)}|[^ \t\f\n]|\Z)")

    _NUMBER = re.compile(
        r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|[1-9](?:_?\d)*|0(?:_?0)*)|(?:(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)[jJ]?|\d(?:_?\d)*[jJ]"
    )
    _BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?![\da-fA-F]{8})|N(?!\{[^}]+\}))")
    _BAD_BYTES = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![\da-fA-F]{2})")

    def classify(self, x: str) -> int:
        c = x[0]
        if "\n" in x and (c == "\n" or c == "#"):
            last = x[x.rindex("\n") + 1 :]
            indent = last[: len(last) - len(last.lstrip(" \t\f"))].replace("\f", "")
            if indent not in self.indent_kinds:
                self.indent_kinds[indent] = -1 - len(self.indent_kinds)
                self.indents[self.indent_kinds[indent]] = indent
            return self.indent_kinds[indent]
        if c == "#":
            return self.NL
        if x[-1] in "\"'" and len(x) > 1:
            head = x[: min(i for i in (x.find('"'), x.find("'")) if i >= 0)].lower()
            if "b" in head:
                return self.kinds["BYTES"] if x.isascii() and ("r" in head or not self._BAD_BYTES.search(x)) else ERR
            if "r" not in head and "\\" in x and self._BAD_ESCAPE.search(x):
                return ERR
            if "f" in head and not self.fields_ok(x, len(head)):
                return ERR
            return self.kinds["STR"]
        if c.isalpha() or c == "_" or c > "\x7f":
            return self.word(x) if x.isidentifier() else ERR
        if c.isdigit() or (c == "." and len(x) > 1 and x[1].isdigit()):
            return self.kinds["NUM"] if self._NUMBER.fullmatch(x) else ERR
        return self.op_kinds.get(x, ERR)

    def fields_ok(self, lexeme: str, head: int) -> bool:
        """Whether the replacement fields of a format string are valid."""
        q = 3 if lexeme[head : head + 3] in ('"""', "'''") and len(lexeme) >= head + 6 else 1
        return self._fields(lexeme[head + q : -q], 0)

    def _fields(self, body: str, depth: int) -> bool:
        i = 0
        while i < len(body):
            c = body[i]
            if c == "{":
                if depth == 0 and body.startswith("{{", i):
                    i += 2
                    continue
                if depth > 1:
                    return False
                j, nest, quote = i + 1, 0, ""
                while j < len(body):
                    d = body[j]
                    if quote:
                        if body.startswith(quote, j):
                            j, quote = j + len(quote) - 1, ""
                    elif d in "\"'":
                        quote = d * 3 if body.startswith(d * 3, j) else d
                        j += len(quote) - 1
                    elif d in "([{":
                        nest += 1
                    elif d in ")]}" and nest:
                        nest -= 1
                    elif nest == 0 and (d in "}:" or d == "!" and not body.startswith("!=", j)):
                        break
                    elif d in "\\#":
                        return False
                    j += 1
                expr = body[i + 1 : j]
                if j >= len(body) or not expr.strip():
                    return False
                if re.search(r"[^=!<>:]=\s*$", expr):
                    expr = expr.rstrip()[:-1]
                if not self.accepts_expression("Factor", f"({expr})"):
                    return False
                if body[j] == "!":
                    if not re.match(r"![rsa]\s*[:}]", body[j:]):
                        return False
                    j = j + 2
                    while body[j].isspace():
                        j += 1
                if body[j] == ":":
                    k, nest = j + 1, 0
                    while k < len(body) and (nest or body[k] != "}"):
                        nest += (body[k] == "{") - (body[k] == "}")
                        k += 1
                    if k >= len(body) or not self._fields(body[j + 1 : k], depth + 1):
                        return False
                    j = k
                i = j + 1
            elif c == "}":
                if depth == 0 and body.startswith("}}", i):
                    i += 2
                    continue
                return False
            else:
                i += 1
        return True

    def prepare(self, text: str) -> str:
        return "\n" + text.removeprefix("\ufeff")

    def tree(self, kinds: list[int]) -> list[int]:
        opens, closes, group, NL = self.opens, self.closes, self.grammar.group, self.NL
        stack: list[tuple] = []
        blocks: list[tuple[list[int], str]] = []
        cur: list[int] = []
        indent = ""
        depth = at = 0
        line = False  # whether the logical line has tokens
        for k in kinds:
            if k < 0:
                if depth:
                    continue
                if line:
                    cur.append(NL << 1)
                    at += 1
                    line = False
                new = self.indents[k]
                if new != indent:
                    if new.startswith(indent):
                        blocks.append((cur, indent))
                        cur, indent = [], new
                        at += 1
                    else:
                        while indent != new:
                            if not blocks or not indent.startswith(new) and not new.startswith(indent):
                                raise Unbalanced(at, "inconsistent indentation")
                            if len(indent) < len(new):
                                raise Unbalanced(at, "inconsistent indentation")
                            inside = cur
                            cur, indent = blocks.pop()
                            cur.append(group(INDENT, inside) << 1)
                            at += 1
            elif k == NL:
                continue
            elif k in opens:
                stack.append((cur, opens[k]))
                cur = []
                depth += 1
                line = True
                at += 1
            elif k in closes:
                if not stack or stack[-1][1] != closes[k]:
                    raise Unbalanced(at, "unbalanced bracket")
                inside = cur
                cur, kind = stack.pop()
                cur.append(group(kind, inside) << 1)
                depth -= 1
                at += 1
            else:
                cur.append(k << 1)
                line = True
                at += 1
        if stack:
            raise Unbalanced(at, "unclosed bracket")
        if line:
            cur.append(NL << 1)
        while blocks:
            inside = cur
            cur, _ = blocks.pop()
            cur.append(group(INDENT, inside) << 1)
        return cur

    def positions(self, text: str) -> list[int]:
        out: list[int] = []
        indents = [""]
        depth, line = 0, False
        for m in self.pattern.finditer(text):
            k = self.lexemes[m.group(1)]
            if k < 0:
                if depth:
                    continue
                if line:
                    out.append(m.start(1))
                    line = False
                new = self.indents[k]
                if len(new) > len(indents[-1]):
                    indents.append(new)
                    out.append(m.end(1))
                while len(new) < len(indents[-1]):
                    indents.pop()
                    out.append(m.end(1))
            elif k != self.NL:
                depth += (k in self.opens) - (k in self.closes)
                out.append(m.start(1))
                line = True
        return out


EXTENSIONS = {
    "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "go": "go", "rs": "rust", "java": "java",
}


@lru_cache(maxsize=None)
def language(name: str) -> Language:
    """The worker's parser of a language."""
    return {"python": Python, "go": Go, "rust": Rust, "java": Java, "javascript": lambda: Script(False), "typescript": lambda: Script(True)}[name]()


LANGUAGES = ("python", "typescript", "javascript", "go", "rust", "java")
