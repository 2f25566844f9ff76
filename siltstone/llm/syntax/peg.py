"""A packrat engine for parsing expression grammars over tokens.

Tokens of one file form a tree: what stands in a pair of brackets (or in an indented block) is one
group token. Equal groups are interned, so a group is one number wherever it stands, and "does the
inside of this group match that rule as a whole" is a memo entry by (rule, group) that holds for
all files of a worker.

Rules marked for it have a second memo, also shared by all files. What a rule does at a position
depends only on the tokens it looks at, so results are kept in a trie of the tokens looked at: a
rule that meets a stretch of tokens it has met before costs one walk along the trie. This is the
packrat table keyed by content in place of position. Both tables are bounded and start anew when
full.

Grammar notation, one rule per line, ``Name = expression`` or ``Name := expression`` with the
trie memo: ``'x'`` a keyword or operator, ``UPPER`` a token class, ``P(X) S(X) B(X) I(X)`` a round,
square, curly or indented group whose inside is wholly ``X``, juxtaposition, ``/``, ``* + ?``,
``&`` and ``!``; ``T(X)`` and ``X(X)`` the substitutions of a template and the parts of a markup element; ``NLB`` and ``NONL`` test for a line break before the next token, ``END`` for the end of the
inside, ``ANY`` takes a token, ``FAIL`` fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable

END = 0
ERR = 1
PAREN, SQUARE, BRACE, INDENT, TEMPLATE, MARKUP = "P", "S", "B", "I", "T", "X"
FIRST_GROUP = 1 << 12
LIMIT = 400_000  # groups or trie nodes kept
LONGEST = 400  # tokens looked at by a result that goes into a trie; longer ones are kept by place for the file at hand
DEEP = 100  # groups within groups judged in one descent

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)+')|([PSBITX]\()|([A-Za-z_][A-Za-z_0-9]*)|([()/*+?&!]))")

Rule = Callable[[list, int], int]


class Deeper(Exception):
    """A group lies too deep for this descent; it is to be judged on its own first."""

    def __init__(self, rule: str, group: int):
        self.rule, self.group = rule, group


class State:
    """What rules look at while they run: how far tokens have been looked at, and where the furthest token failed."""

    __slots__ = ("depth", "far", "failed", "offset", "quiet", "wanted")

    def __init__(self) -> None:
        self.far = self.depth = self.quiet = 0
        self.failed = -1
        self.offset: list[int] = []
        self.wanted: set[str] = set()


class Kinds:
    """Numbers of token kinds."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {"END": END, "ERR": ERR}
        self.names: list[str] = ["end", "illegal text"]

    def __getitem__(self, name: str) -> int:
        if name not in self.of:
            self.of[name] = len(self.names)
            self.names.append(name)
        return self.of[name]


class Grammar:
    def __init__(self, text: str, kinds: Kinds, classes: dict[str, set[str]]):
        self.kinds, self.classes = kinds, classes
        self.rules: dict[str, tuple[bool, tuple]] = {}
        self.named = set(re.findall(r"^\s*(\w+)\s*:?=", text, re.M))
        body = re.sub(r"\n\s+", " ", "\n".join(x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")))
        for line in body.splitlines():
            if line.strip():
                name, op, expr = re.fullmatch(r"\s*(\w+)\s*(:?=)\s*(.*)", line).groups()
                self.rules[name] = (op == ":=", self._parse(expr))
        self.state = State()
        self._plain = self._compile_all(False)
        self._traced = self._compile_all(True)
        self.clear()

    # The tables of a worker.

    def clear(self) -> None:
        self.groups: dict[tuple, int] = {}
        self.inside: list[tuple[str, list[int]]] = []
        self.known: dict[tuple[str, int], bool] = {}
        self.spans: list[int] = []
        for trie in self.tries.values():
            trie.clear()
        self.nodes = 0

    def tidy(self) -> None:
        """Between files: start the tables anew if they are full."""
        self.placed.clear()
        if len(self.inside) > LIMIT or self.nodes > 4 * LIMIT:
            self.clear()

    def group(self, kind: str, tokens: list[int]) -> int:
        """The number of a group token."""
        key = (kind, *tokens)
        got = self.groups.get(key)
        if got is None:
            got = self.groups[key] = FIRST_GROUP + len(self.inside)
            self.inside.append((kind, tokens))
        return got

    def accepts(self, rule: str, tokens: list[int]) -> bool:
        """Whether the tokens as a whole match the rule; ``tokens`` has no end mark yet.

        Groups nested deeper than ``DEEP`` wait on a stack until those inside them are known, so depth costs no recursion.
        """
        s = self.state
        waiting: list[tuple[str, int]] = []
        while True:
            s.far = s.depth = 0
            self.placed.clear()
            try:
                if not waiting:
                    return self._plain[rule]([*tokens, END], 0) == len(tokens)
                name, k = waiting[-1]
                inside = self.inside[k - FIRST_GROUP][1]
                self.known[name, k] = self._plain[name]([*inside, END], 0) == len(inside)
                waiting.pop()
            except Deeper as e:
                waiting.append((e.rule, e.group))

    def furthest(self, rule: str, tokens: list[int]) -> tuple[int, list[str]]:
        """The plain token at which the furthest failure lies, and what was wanted there."""
        s = self.state
        s.failed, s.wanted, s.quiet = -1, set(), 0
        self.met.clear()
        s.offset = self._offsets(tokens, 0)
        t = [*tokens, END]
        end = self._traced[rule](t, 0)
        self.met.clear()
        if 0 <= end < len(tokens) and s.offset[end] > s.failed:
            s.failed, s.wanted = s.offset[end], {"end"}
        return max(s.failed, 0), sorted(s.wanted)

    def _offsets(self, tokens: list[int], start: int) -> list[int]:
        out = [start]
        for x in tokens:
            k = x >> 1
            start += 1 if k < FIRST_GROUP else self._span(k)
            out.append(start)
        return out

    def _span(self, group: int) -> int:
        """How many plain tokens a group stands for, its two brackets included. Inner groups come before outer ones."""
        spans = self.spans
        while len(spans) <= group - FIRST_GROUP:
            spans.append(2 + sum([1 if x >> 1 < FIRST_GROUP else spans[(x >> 1) - FIRST_GROUP] for x in self.inside[len(spans)][1]]))
        return spans[group - FIRST_GROUP]

    # Reading the notation.

    def _parse(self, text: str) -> tuple:
        toks = [m.groups() for m in _TOKEN.finditer(text)]
        if "".join(filter(None, (x for t in toks for x in t))).replace(" ", "") != text.replace(" ", ""):
            raise ValueError(f"cannot read: {text}")
        pos = 0

        def choice() -> tuple:
            nonlocal pos
            alts = [seq()]
            while pos < len(toks) and toks[pos][3] == "/":
                pos += 1
                alts.append(seq())
            return alts[0] if len(alts) == 1 else ("choice", alts)

        def seq() -> tuple:
            items = []
            while pos < len(toks) and toks[pos][3] not in ("/", ")"):
                items.append(prefix())
            return items[0] if len(items) == 1 else ("seq", items)

        def prefix() -> tuple:
            nonlocal pos
            if toks[pos][3] in ("&", "!"):
                op = toks[pos][3]
                pos += 1
                return ("and" if op == "&" else "not", prefix())
            x = atom()
            while pos < len(toks) and toks[pos][3] in ("*", "+", "?"):
                x = ({"*": "star", "+": "plus", "?": "opt"}[toks[pos][3]], x)
                pos += 1
            return x

        def atom() -> tuple:
            nonlocal pos
            lit, grp, name, op = toks[pos]
            pos += 1
            if lit:
                return ("set", frozenset([self.kinds[lit[1:-1]]]))
            if grp:
                inner = choice()
                pos += 1
                if inner[0] != "rule":
                    name = f"_{len(self.rules)}_{pos}_{grp[0]}{abs(hash(str(inner)))}"
                    self.rules[name] = (False, inner)
                    inner = ("rule", name)
                return ("group", grp[0], inner[1])
            if name:
                if name in ("NLB", "NONL", "FAIL", "ANY"):
                    return (name,)
                if name in self.classes:
                    return ("set", frozenset(self.kinds[x] for x in self.classes[name]))
                if name.isupper() and name not in self.named:
                    return ("set", frozenset([self.kinds[name]]))
                return ("rule", name)
            if op != "(":
                raise ValueError(f"unexpected {op} in {text}")
            inner = choice()
            pos += 1
            return inner

        got = choice()
        if pos != len(toks):
            raise ValueError(f"unread rest of: {text}")
        return got

    # Making functions of rules.

    def _compile_all(self, traced: bool) -> dict[str, Rule]:
        table: dict[str, Rule] = {}
        if not traced:
            self.tries: dict[str, dict] = {}
            self.placed: dict[tuple[int, str, int], tuple[int, int, list]] = {}
        self.met: dict[tuple[str, int, bool], int] = {}
        for name, (memo, expr) in self.rules.items():
            f = self._compile(expr, table, traced)
            if memo and not traced:
                f = self._with_trie(name, f)
            if traced:
                f = self._with_table(name, f)
            table[name] = f
        return table

    def _with_table(self, name: str, f: Rule) -> Rule:
        """The packrat table of the search for the furthest failure: by rule and place, and whether failures count there."""
        s, met = self.state, self.met

        def run(t: list, i: int) -> int:
            key = (name, s.offset[i], s.quiet > 0)
            end = met.get(key)
            if end is None:
                end = met[key] = f(t, i)
            return end

        return run

    def _with_trie(self, name: str, f: Rule) -> Rule:
        trie = self.tries[name] = {}
        s, placed = self.state, self.placed

        def run(t: list, i: int) -> int:
            node, j, last = trie, i, len(t) - 1
            while True:
                node = node.get(t[j])
                if node is None:
                    break
                j += 1
                if type(node) is int:  # a leaf: how many tokens the rule takes, or -1
                    if j > s.far:
                        s.far = j
                    return i + node if node >= 0 else -1
                if j > last:
                    break
            key = (id(t), name, i)
            kept = placed.get(key)
            if kept is not None:
                end, far, _ = kept
                s.far = max(s.far, far)
                return end
            outer, s.far = s.far, i + 1
            end = f(t, i)
            far = min(s.far, last + 1)
            if far - i > LONGEST:
                placed[key] = end, far, t  # holds the tokens, so that their identity stays theirs
                s.far = max(outer, far)
                return end
            node = trie
            for x in t[i : far - 1]:
                node = node.setdefault(x, {})
                if type(node) is int:
                    break
            else:
                node[t[far - 1]] = end - i if end >= 0 else -1
                self.nodes += far - i
            s.far = max(outer, far)
            return end

        return run

    def _compile(self, e: tuple, table: dict[str, Rule], traced: bool) -> Rule:
        s, op = self.state, e[0]
        names = self.kinds.names
        if op == "set":
            kinds = e[1]
            if traced:

                def term(t: list, i: int) -> int:
                    if t[i] >> 1 in kinds:
                        return i + 1
                    at = s.offset[i]
                    if at > s.failed:
                        s.failed, s.wanted = at, set()
                    if at == s.failed and len(kinds) < 12:
                        s.wanted.update(names[k] for k in kinds)
                    return -1

                return term
            if len(kinds) == 1:
                (kind,) = kinds

                def one(t: list, i: int) -> int:
                    if i >= s.far:
                        s.far = i + 1
                    return i + 1 if t[i] >> 1 == kind else -1

                if kind == END:
                    return lambda t, i, one=one: i if one(t, i) >= 0 else -1
                return one

            def many(t: list, i: int) -> int:
                if i >= s.far:
                    s.far = i + 1
                return i + 1 if t[i] >> 1 in kinds else -1

            return many
        if op == "rule":
            name = e[1]
            if name not in self.rules:
                raise ValueError(f"no rule {name}")
            return lambda t, i: table[name](t, i)
        if op == "group":
            return self._group(e[1], e[2], table, traced)
        if op == "seq":
            parts = [self._compile(x, table, traced) for x in e[1]]

            def seq(t: list, i: int) -> int:
                for p in parts:
                    i = p(t, i)
                    if i < 0:
                        return -1
                return i

            return seq
        if op == "choice":
            alts = e[1]
            if all(a[0] == "set" and END not in a[1] for a in alts):
                return self._compile(("set", frozenset().union(*(a[1] for a in alts))), table, traced)
            parts = [self._compile(x, table, traced) for x in alts]

            def choice(t: list, i: int) -> int:
                for p in parts:
                    j = p(t, i)
                    if j >= 0:
                        return j
                return -1

            return choice
        if op in ("star", "plus"):
            p = self._compile(e[1], table, traced)
            least = op == "plus"

            def many_(t: list, i: int) -> int:
                n = 0
                while True:
                    j = p(t, i)
                    if j <= i:  # failed, or took nothing
                        return i if n or j == i or not least else -1
                    i = j
                    n += 1

            return many_
        if op == "opt":
            p = self._compile(e[1], table, traced)

            def opt(t: list, i: int) -> int:
                j = p(t, i)
                return j if j >= 0 else i

            return opt
        if op in ("and", "not"):
            p = self._compile(e[1], table, traced)
            want = op == "and"

            def look(t: list, i: int) -> int:
                if traced and not want:
                    kept = s.failed, s.wanted
                    s.wanted = set(s.wanted)
                    s.quiet += 1
                    hit = p(t, i) >= 0
                    s.quiet -= 1
                    s.failed, s.wanted = kept
                else:
                    hit = p(t, i) >= 0
                return i if hit == want else -1

            return look
        if op in ("NLB", "NONL"):
            want = 1 if op == "NLB" else 0

            def nl(t: list, i: int) -> int:
                if i >= s.far:
                    s.far = i + 1
                return i if t[i] & 1 == want else -1

            return nl
        if op == "ANY":

            def any_(t: list, i: int) -> int:
                if i >= s.far:
                    s.far = i + 1
                return i + 1 if t[i] >> 1 not in (END, ERR) else -1

            return any_
        if op == "FAIL":
            return lambda t, i: -1
        raise ValueError(op)

    def _group(self, kind: str, rule: str, table: dict[str, Rule], traced: bool) -> Rule:
        s = self.state

        def group(t: list, i: int) -> int:
            if i >= s.far:
                s.far = i + 1
            k = t[i] >> 1
            if k < FIRST_GROUP:
                if traced and s.offset[i] > s.failed:
                    s.failed, s.wanted = s.offset[i], set()
                return -1
            have, inside = self.inside[k - FIRST_GROUP]
            if have != kind:
                if traced and s.offset[i] > s.failed:
                    s.failed, s.wanted = s.offset[i], set()
                return -1
            if traced:
                if self.known.get((rule, k)):
                    return i + 1
                outer = s.offset
                s.offset = self._offsets(inside, outer[i] + 1)
                end = table[rule]([*inside, END], 0)
                if 0 <= end < len(inside) and s.offset[end] > s.failed:
                    s.failed, s.wanted = s.offset[end], {"end"}
                s.offset = outer
                return i + 1 if end == len(inside) else -1
            hit = self.known.get((rule, k))
            if hit is None:
                if s.depth >= DEEP:
                    raise Deeper(rule, k)
                s.depth += 1
                outer_far, s.far = s.far, 0
                hit = self.known[rule, k] = table[rule]([*inside, END], 0) == len(inside)
                s.far = outer_far
                s.depth -= 1
            return i + 1 if hit else -1

        return group
