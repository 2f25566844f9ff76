"""The graphs of whole tables of files, kept in factors: who asks for what, and which files that means.

An ambiguous name leads every file that asks for it to every file that defines it, so the edges of a
repository grow with the square of its files. They are never shuffled here. A row a file is sent once,
to the task of its repository; a repository with many references is cut into parts by its files, and
each part also gets the paths and the names of all of them. A part resolves its own references as
``resolve`` does, and keeps *entries* (source, kind, symbol, target set) with every target set written
once. Edges are formed from that, in blocks, only where they are the result; neighbourhoods and ranks
are computed on the sets.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_left
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import discard, materialize, scratch_dir
from .index import WEIGHTS
from .pagerank import ALPHA, MAX_STEPS, TOLERANCE, power_iteration

DECAY = 0.6
PART_REFS = 20_000  # references a part
MAX_PARTS = 24  # each part also gets the paths and names of all files
KERNEL_PAIRS = 4_000_000  # (source, target) pairs up to which a repository is ranked at one go
BLOCK = 50_000  # pairs formed at a time

PARTS = "repo string, part int, loop boolean, blob binary"
EDGES = "repo string, src string, dst string, kind string, symbols array<string>"


#: A file as it is sent; what is its own alone (its references and its test's stem) goes to one part only.
Row = namedtuple("Row", "repo part many own path indexed_at run_id language value names given mark stem r_name r_kind r_target r_ord")

# One part: built from rows.


def _normal(c: str) -> str:
    """``text.normalize_path`` on the driver's side of Arrow."""
    c = c.replace("\\", "/")
    rooted, out = c.startswith("/"), []
    for p in c.split("/"):
        if p in ("", "."):
            continue
        if p != "..":
            out.append(p)
        elif out and out[-1] != "..":
            out.pop()
        elif not rooted:
            out.append(p)
    joined = "/".join(out)
    return "/" + joined if rooted else joined or "."


def _dir(path: str) -> str:
    return path[: path.rfind("/")] if "/" in path else "."


def _last(name: str) -> str:
    return name[name.rfind(".") + 1 :]


def _candidates(folder: str, language: str, target: str) -> list[str]:
    """The paths an import may mean, in order (``resolve._candidates``)."""
    at = "" if folder == "." else folder + "/"
    if language == "python":
        name = target.strip(" \t\n\r\f")
        if name.startswith("."):
            rest = name.lstrip(".")
            dots, rest = len(name) - len(rest), rest.replace(".", "/")
            folders = [x for x in folder.split("/") if x != "."]
            base = "/".join(folders[: max(len(folders) - dots + 1, 0)])
            up = base + "/" if base else ""
            return [f"{up}{rest}.py", f"{up}{rest}/__init__.py"] if rest else [f"{up}__init__.py"]
        last, slashed = _last(name), name.replace(".", "/")
        return [f"{at}{last}.py", f"{slashed}.py", f"{slashed}/__init__.py", f"{at}{last}/__init__.py"]
    if language in ("typescript", "javascript") and target.startswith((".", "/")):
        start = target if target.startswith("/") else at + target
        return [start + x for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")]
    if language == "rust" and target.startswith("crate::"):
        parts = target[7:].split("::")
        module = "/".join(parts[:-1] if len(parts) > 1 else parts)
        return [f"src/{module}.rs", f"src/{module}/mod.rs"]
    if language == "rust" and target.startswith("super::"):
        above = _dir(folder)
        above, one = "" if above == "." else above + "/", target[7:].split("::", 1)[0]
        return [f"{above}{one}.rs", f"{above}{one}/mod.rs"]
    return [target.replace(".", "/") + ".java"] if language == "java" else []


def _lookup(language: str, target: str) -> str | None:
    """The symbol name a reference is looked up by (``resolve._lookup_name``)."""
    if language == "python":
        name = target.strip(" ")
        return None if name.startswith(".") else _last(name)
    if language == "rust":
        return target.rsplit("::", 1)[-1]
    if language == "java":
        return _last(target)
    return None if language in ("typescript", "javascript", "go") else target


def _nulls_first(v) -> tuple:
    return (v is not None, v) if v is not None else (False,)


class _Index:
    """What a repository's references are resolved by; every table of it is made when first asked for."""

    def __init__(self, nodes: list[str], known: np.ndarray, names: list[list[str]]):
        self.nodes, self.known, self.names = nodes, known, names
        self.files = np.flatnonzero(known).tolist()
        self.id = {nodes[i]: i for i in self.files}
        self.dir = [_dir(p) for p in nodes]
        self.top = [p.split("/", 1)[0] if "/" in p else "" for p in nodes]
        self.hubs: list[np.ndarray] = []
        self.hub_of: dict = {}
        self.places: dict = {}
        self.bags: dict[str, list[int]] = {}
        for i in self.files:
            for n in names[i]:
                self.bags.setdefault(n, []).append(i)
        self.split: dict = {}
        self.made: dict = {}

    def table(self, what: str) -> dict:
        if what not in self.made:
            out: dict = {}
            if what == "classes":
                for i in self.files:
                    if self.nodes[i].endswith(".java"):
                        out.setdefault(self.nodes[i].rsplit("/", 1)[-1], []).append(i)
            elif what == "folders":
                for i in self.files:
                    out.setdefault(self.dir[i], []).append(i)
            elif what == "suffixes":
                for d in self.table("folders"):
                    parts = d.split("/")
                    for k in range(len(parts)):
                        out.setdefault("/".join(parts[k:]), []).append(d)
            self.made[what] = out
        return self.made[what]

    def hub(self, key, ids: Callable[[], list[int]]) -> int | None:
        if key not in self.hub_of:
            got = np.unique(np.asarray(ids(), np.int32))
            self.hub_of[key] = len(self.hubs) if len(got) else None
            if len(got):
                self.hubs.append(got)
        return self.hub_of[key]

    def one(self, i: int) -> int:
        return self.hub(i, lambda: [i])

    def _place(self, folder: str, language: str, target: str) -> int | None:
        """By path, class or folder: the same for all files of a folder and a language."""
        for c in _candidates(folder, language, target):
            i = self.id.get(_normal(c))
            if i is not None:
                return self.one(i)
        if language == "java":
            named = self.table("classes").get(_last(target) + ".java")
            if named:
                cut = target[: target.rfind(".")].replace(".", "/") if "." in target else ""
                return self.one(next((i for i in named if cut and cut in self.nodes[i]), named[0]))
            if target.endswith(".*"):
                return self.hub(("below", target), lambda: self._below(target[:-2].replace(".", "/") + "/"))
        if language == "go":
            dirs = self.table("suffixes").get(target, [])
            dirs = [target] if target in dirs else dirs
            return self.hub(("in", target), lambda: [i for d in dirs for i in self.table("folders")[d]])
        return None

    def _below(self, start: str) -> list[int]:
        out, i = [], bisect_left(self.nodes, start)
        while i < len(self.nodes) and self.nodes[i].startswith(start):
            if self.known[i] and self.nodes[i].endswith(".java"):
                out.append(i)
            i += 1
        return out

    def _group(self, name: str, by: str, value: str) -> list[int]:
        if (name, by) not in self.split:
            groups, of = {}, self.dir if by == "dir" else self.top
            for i in self.bags[name]:
                groups.setdefault(of[i], []).append(i)
            self.split[name, by] = groups
        return self.split[name, by].get(value, [])

    def resolve(self, i: int, language: str, target: str) -> int | None:
        """The target set of a reference of file ``i``; a set may hold the file itself."""
        key = (self.dir[i], language, target)
        if key not in self.places:
            self.places[key] = (self._place(*key), _lookup(language, target))
        hub, name = self.places[key]
        if hub is not None:
            return hub
        bag = self.bags.get(name) if name is not None else None
        if bag is None:
            return None
        own = self.names[i].count(name) if language != "java" else 0
        if len(bag) - own <= 0:
            return None
        for by, value in (("", ""), ("dir", self.dir[i]), ("top", self.top[i])):
            group = self._group(name, by, value) if by else bag
            if len(group) - own == 1:
                return self.one(group[-1] if own and group[0] == i else group[0])
            if language == "java":
                break
        return self.hub(("name", name), lambda: bag)

    def sources(self, language: str, stem: str) -> dict[str, list[tuple[int, str, int]]]:
        """The two nearest files of a language and stem below each folder (``graph.test_edges``)."""
        from .graph import SOURCE_EXTENSIONS

        if "stems" not in self.made:
            self.made["stems"] = {}
            of = {e: k for k, es in SOURCE_EXTENSIONS.items() for e in es}
            for i in self.files:
                base = self.nodes[i].rsplit("/", 1)[-1]
                dot = base.rfind(".")
                if 0 < dot < len(base) - 1 and base[dot:] in of:
                    self.made["stems"].setdefault((of[base[dot:]], base[:dot]), []).append(i)
        if ("near", language, stem) not in self.made:
            out: dict = {}
            for i in self.made["stems"].get((language, stem), []):
                dirs = [x for x in self.dir[i].split("/") if x != "."]
                for k in range(len(dirs) + 1):
                    out.setdefault("/".join(dirs[:k]), []).append((len(dirs), self.nodes[i], i))
            self.made["near", language, stem] = {d: sorted(v)[:2] for d, v in out.items()}
        return self.made["near", language, stem]

    def source_of(self, i: int, language: str, stem: str) -> int | None:
        near, dirs, best = self.sources(language, stem), [x for x in self.dir[i].split("/") if x != "."], None
        for k in range(len(dirs) + 1) if near else ():
            for far, path, j in near.get("/".join(dirs[:k]), ()):
                if j != i and (best is None or (len(dirs) + far - 2 * k, path) < best[:2]):
                    best = (len(dirs) + far - 2 * k, path, j)
        return best and best[2]


class Part:
    """A part: ``nodes`` in order with ``known`` and ``value``, and the entries of its own files.

    Entry ``e`` says that ``nodes[src[e]]`` has edges of ``kinds[kind[e]]`` for ``symbols[sym[e]]`` to the
    nodes ``ids[off[hub[e]]:off[hub[e] + 1]]``. A source's entries stand in the order of its edges' symbols.
    """

    def __init__(self, **parts):
        self.__dict__.update(parts)

    def pack(self) -> bytes:
        raw = pickle.dumps(self.__dict__, 5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def unpack(blob: bytes) -> Part:
        return Part(**pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)))

    @staticmethod
    def build(rows: list[Row]) -> Part:
        latest: dict[str, Row] = {}
        order = lambda r: tuple(map(_nulls_first, (r.indexed_at, r.run_id, r.language, tuple(r.names), r.mark)))
        for r in rows:
            old = latest.get(r.path)
            if old is None or order(r) > order(old):
                latest[r.path] = r
        nodes = sorted(latest.keys() | {g for r in latest.values() for g in r.given})
        known = np.array([p in latest for p in nodes], bool)
        value = np.array([latest[p].value or 0.0 if p in latest else 0.0 for p in nodes], float)
        index = _Index(nodes, known, [latest[p].names if p in latest else [] for p in nodes])
        every = {p: i for i, p in enumerate(nodes)}
        out: list[tuple] = []
        for i in index.files:
            r = latest[nodes[i]]
            if r.own:
                out += [(i, *e) for e in _entries(index, every, i, r)]
        kinds = sorted({e[1] for e in out}, key=_nulls_first)
        symbols = sorted({e[2] for e in out}, key=_nulls_first)
        kind_of, symbol_of = {k: n for n, k in enumerate(kinds)}, {s: n for n, s in enumerate(symbols)}
        used = sorted({e[3] for e in out})
        hub_of = {h: n for n, h in enumerate(used)}
        sets = [index.hubs[h] for h in used]
        return Part(
            repo=rows[0].repo, nodes=nodes, known=known, value=value, kinds=kinds, symbols=symbols,
            src=np.array([e[0] for e in out], np.int32), kind=np.array([kind_of[e[1]] for e in out], np.int32), sym=np.array([symbol_of[e[2]] for e in out], np.int32),
            hub=np.array([hub_of[e[3]] for e in out], np.int32), off=np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64), ids=np.concatenate([np.empty(0, np.int32), *sets]),
        )

    @property
    def n(self) -> int:
        return len(self.nodes)

    def lengths(self) -> np.ndarray:
        return np.diff(self.off)[self.hub]

    def around(self, keep: np.ndarray) -> Part:
        """With the edges from or to the marked nodes only."""
        held = keep[self.ids]
        reached = np.concatenate([[0], np.cumsum(held)])[self.off]
        hub = np.where(keep[self.src], self.hub, self.hub + len(self.off) - 1)
        return Part(**self.__dict__ | {"hub": hub, "off": np.concatenate([self.off, self.off[-1] + reached[1:]]), "ids": np.concatenate([self.ids, self.ids[held]])})

    def blocks(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``entry, dst`` of all pairs without those of a node to itself, some whole sources at a time."""
        lengths, m = self.lengths(), len(self.src)
        firsts = np.flatnonzero(np.diff(self.src, prepend=-1))
        starts = np.append(np.concatenate([[0], np.cumsum(lengths)])[firsts], lengths.sum()) if m else np.zeros(1)
        k = 0
        while k < len(firsts):
            to = max(k + 1, int(np.searchsorted(starts, starts[k] + block, "right")) - 1)
            a, b = firsts[k], firsts[to] if to < len(firsts) else m
            each = lengths[a:b]
            entry = np.repeat(np.arange(a, b), each)
            place = np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each)
            dst = self.ids[self.off[self.hub[entry]] + place]
            other = dst != self.src[entry]
            yield entry[other], dst[other]
            k = to

    def edges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of ``src, kind, dst, starts, symbols``: the edges, and where each one's symbols start."""
        for entry, dst in self.blocks():
            if len(dst):
                key = (self.src[entry].astype(np.int64) * len(self.kinds) + self.kind[entry]) * self.n + dst
                order = np.argsort(key, kind="stable")
                key, entry, dst = key[order], entry[order], dst[order]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                first = entry[starts]
                yield self.src[first], self.kind[first], dst[starts], np.append(starts, len(key)), self.sym[entry]

    def kind_weights(self) -> np.ndarray:
        return np.array([WEIGHTS.get(k, 1.0) for k in self.kinds])

    def weights(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of ``src, dst, weight``, every source whole: weights of parallel kinds added."""
        w, k = self.kind_weights(), max(1, len(self.kinds))
        for entry, dst in self.blocks():
            key = np.sort((self.src[entry].astype(np.int64) * self.n + dst) * k + self.kind[entry])
            key = key[np.flatnonzero(np.diff(key, prepend=-1))]
            starts = np.flatnonzero(np.diff(key // k, prepend=-1))
            if len(key):
                arc = key[starts] // k
                yield (arc // self.n).astype(np.int32), (arc % self.n).astype(np.int32), np.add.reduceat(w[key % k], starts)

    def hop(self, x: np.ndarray, decay: float = DECAY) -> np.ndarray:
        """The greatest value of a neighbour in either direction, times ``decay``.

        A node may count as its own neighbour here, which changes no result of ``near``: its own value is greater.
        """
        return _hop(x, self.src, self.hub, self.off, self.ids) * decay

    def near(self, x: np.ndarray, hops: int = 2) -> np.ndarray:
        out = front = x
        for _ in range(hops):
            front = self.hop(front)
            out = np.maximum(out, front)
        return out

    def start(self, personal: bool) -> np.ndarray:
        w = np.maximum(self.value, 0.0)
        return w / w.sum() if personal and w.sum() > 0 else np.full(self.n, 1 / max(1, self.n))


def _hop(x: np.ndarray, src: np.ndarray, hub: np.ndarray, off: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    if len(src):
        sent = np.zeros(len(off) - 1)
        np.maximum.at(sent, hub, x[src])
        np.maximum.at(out, ids, np.repeat(sent, np.diff(off)))
        np.maximum.at(out, src, np.maximum.reduceat(x[ids], off[:-1])[hub])
    return out


def _entries(index: _Index, every: dict[str, int], i: int, r: Row) -> list[tuple]:
    """``kind, symbol, target set`` of a file, by the least ``ord`` of each; a target is named once for a kind and symbol."""
    raw = []
    for name, kind, target, place in zip(r.r_name, r.r_kind, r.r_target, r.r_ord, strict=True):
        if target is not None:
            raw.append((place, name, kind, index.one(every[target])))
        elif name is not None:
            hub = index.resolve(i, r.language, name)
            if hub is not None:
                raw.append((place, name, kind, hub))
    if r.stem is not None:
        j = index.source_of(i, r.language, r.stem)
        if j is not None:
            raw.append((0, "test:" + r.stem, "tests", index.one(j)))
    raw.sort(key=lambda e: (_nulls_first(e[0]), _nulls_first(e[1])))
    out, seen = [], {}
    for _, name, kind, hub in raw:
        had = seen.setdefault((kind, name), {})
        if hub in had:
            continue
        new = hub
        if had:  # given and resolved targets of one name
            rest = np.setdiff1d(index.hubs[hub], np.concatenate([index.hubs[h] for h in had]))
            new = index.hub(("rest", hub, *had), lambda rest=rest: rest)
        had[hub] = True
        if new is not None:
            out.append((kind, name, new))
    return out


# All parts of a table.


def parts_of(files: DataFrame, value: Column | str = "0.0D", first: bool = False, part_refs: int = PART_REFS, loop: bool = False) -> DataFrame:
    """The parts of every repository's graph, written once: ``repo, part, loop, blob``.

    ``files`` is the files table, or what ``index.current_files`` makes of it; of rows of one (repo, path)
    the latest counts. ``value`` is a file's number, for seeds or scores, from its path and symbols; with ``first``
    only the first file by path that has one above 0 keeps it.
    ``loop`` marks repositories of several parts or many pairs, whose ranks are computed in several steps; with
    the argument, all.
    """
    spark = files.sparkSession
    from .graph import test_stem

    files = files.filter("repo is not null and path is not null")
    kept = {c: F.col(c) if c in files.columns else F.lit(None).cast(kind) for c, kind in (("indexed_at", "timestamp"), ("run_id", "bigint"))}
    n_refs = F.coalesce(F.size("refs.ord"), F.lit(0))
    large = files.groupBy("repo").agg(F.sum(n_refs).alias("m")).filter(F.col("m") > part_refs)
    large = large.select("repo", F.least(F.lit(MAX_PARTS), F.ceil(F.col("m") / part_refs)).cast("int").alias("_parts"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    none = "cast(array() as array<string>)"
    language = F.expr(f"coalesce(language, {t.language_of('path')}, 'unknown')")
    row = files.select(
        "repo", "path", kept["indexed_at"].alias("indexed_at"), kept["run_id"].alias("run_id"), language.alias("language"), (F.expr(value) if isinstance(value, str) else value).alias("value"),
        F.expr(f"filter(coalesce(symbols.name, {none}), x -> x is not null)").alias("names"), F.expr(f"array_distinct(filter(coalesce(refs.target_file, {none}), x -> x is not null))").alias("given"),
        F.xxhash64("refs.target_name", "refs.kind", "refs.target_file", "refs.ord").alias("mark"), F.expr(f"coalesce(refs.target_name, {none})").alias("r_name"),
        F.expr(f"transform(coalesce(refs.kind, {none}), x -> lower(trim(x)))").alias("r_kind"), F.expr(f"coalesce(refs.target_file, {none})").alias("r_target"),
        F.expr("coalesce(refs.ord, cast(array() as array<int>))").alias("r_ord"),
    ).withColumn("stem", test_stem())
    # Few repositories have several parts: as many at most as there are references by part_refs.
    row = row.join(F.broadcast(large.withColumnRenamed("repo", "_large")), F.col("repo") == F.col("_large"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    row = row.withColumn("_own", F.pmod(F.xxhash64("path"), F.col("_parts")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)"))).withColumn("own", F.col("part") == F.col("_own"))
    sent = {c: F.when(F.col("own"), F.col(c)) for c in ("r_name", "r_kind", "r_target", "r_ord", "stem")}
    slot = F.pmod(F.pmod(F.xxhash64("repo"), F.lit(n)) + F.col("part"), F.lit(n)).cast("int")
    row = row.withColumns(sent).withColumn("many", F.col("_parts") > 1).withColumn("slot", slot).drop("_parts", "_own", "_large").repartitionById(n, F.col("slot")).select(*Row._fields).sortWithinPartitions("repo", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            p = Part.build(rows)
            if first and (p.value > 0).any():
                p.value[np.arange(p.n) != np.argmax(p.value > 0)] = 0.0
            heavy = loop or rows[0].many or int(p.lengths().sum()) > KERNEL_PAIRS
            yield pa.RecordBatch.from_pylist([{"repo": p.repo, "part": rows[0].part, "loop": heavy, "blob": p.pack()}], _schema(PARTS))

    return materialize(row.mapInArrow(run, PARTS), "parts")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
    """The rows of one (repo, part) after the other."""
    rows: list[Row] = []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        columns[9] = [list(map(sys.intern, names)) for names in columns[9]]
        for r in map(Row._make, zip(*columns, strict=True)):
            if rows and rows[0][:2] != r[:2]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


def _each(parts: DataFrame, make: Callable[[Part], Iterator[list]], ddl: str, only: str | None = None) -> DataFrame:
    """``make`` over every part; it gives lists of columns. ``only``: a column of paths, to whose edges the part is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(ddl)
        for b in batches:
            for k, blob in enumerate(b.column("blob")):
                p = Part.unpack(blob.as_py())
                if only:
                    marked = set(b.column(only)[k].as_py())
                    p = p.around(np.array([x in marked for x in p.nodes], bool))
                for columns in make(p):
                    repo = pa.array([p.repo], pa.string()).take(pa.array(np.zeros(len(columns[0]), np.int32)))
                    yield pa.RecordBatch.from_arrays([repo, *[pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return parts.select("blob", *([only] if only else [])).mapInArrow(run, ddl)


def edges(parts: DataFrame) -> DataFrame:
    """``repo, src, dst, kind, symbols``: one edge per kind, its symbols distinct, in the order first seen."""

    def make(p: Part) -> Iterator[list]:
        nodes, kinds, symbols = pa.array(p.nodes, pa.string()), pa.array(p.kinds, pa.string()), pa.array(p.symbols, pa.string())
        for src, kind, dst, starts, sym in p.edges():
            yield [nodes.take(pa.array(src)), nodes.take(pa.array(dst)), kinds.take(pa.array(kind)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), symbols.take(pa.array(sym)))]

    return _each(parts, make, EDGES)


def weights(parts: DataFrame) -> DataFrame:
    """``repo, src, dst, weight, out_weight``: the simple weighted graph, and what leaves each source."""

    def make(p: Part) -> Iterator[list]:
        nodes = pa.array(p.nodes, pa.string())
        for src, dst, w in p.weights():
            yield [nodes.take(pa.array(src)), nodes.take(pa.array(dst)), w, np.bincount(src, w, p.n)[src]]

    return _each(parts, make, "repo string, src string, dst string, weight double, out_weight double")


def neighbors(parts: DataFrame, limit: int = 3, only: DataFrame | None = None) -> DataFrame:
    """``repo, path, k, other, direction, kind, symbols``: as ``evidence.evidence_neighbors``, cut in every part and then in all.

    ``only`` names nodes, few a repository; of repositories in parts just their edges are formed.
    """

    def make(p: Part) -> Iterator[list]:
        lower = {s: k for k, s in enumerate(sorted({x.lower() for x in p.nodes}))}
        low = np.array([lower[x.lower()] for x in p.nodes], np.int64)
        node_bits, kind_bits = p.n.bit_length(), len(p.kinds).bit_length()
        if 2 * node_bits + kind_bits > 59:
            raise ValueError("too many files in one repository to order its neighbours")
        last = {i: len(p.symbols) if s is None else i for i, s in enumerate(p.symbols)}  # a null symbol stands last
        worst = np.full(p.n, np.iinfo(np.int64).max)
        best: list[list] = []

        def cut() -> None:
            cols = [np.concatenate(c) for c in zip(*best, strict=True)]
            order = np.lexsort((cols[1], cols[0]))
            node = cols[0][order]
            firsts = np.flatnonzero(np.diff(node, prepend=-1))
            place = np.arange(len(node)) - np.repeat(firsts, np.diff(np.append(firsts, len(node))))
            kept = order[place < limit]
            best[:] = [[c[kept] for c in cols]]
            full = order[place == limit - 1]
            worst[cols[0][full]] = cols[1][full]

        for src, kind, dst, starts, sym in p.edges():
            few = 5 - np.minimum(np.diff(starts), 5)
            for incoming, node, other in ((0, dst, src), (1, src, dst)):  # "incoming" comes before "outgoing"
                key = (((few.astype(np.int64) << node_bits | low[other]) << 1 | incoming) << kind_bits | kind) << node_bits | other
                maybe = np.flatnonzero(key < worst[node])
                order = maybe[np.lexsort((key[maybe], node[maybe]))]
                got = node[order]
                firsts = np.flatnonzero(np.diff(got, prepend=-1))
                order = order[np.arange(len(got)) - np.repeat(firsts, np.diff(np.append(firsts, len(got)))) < limit]
                syms = np.full(len(order), None, object)
                for k, e in enumerate(order):
                    syms[k] = sorted(sym[starts[e] : starts[e + 1]].tolist(), key=last.__getitem__)[:5]
                best.append([node[order], key[order], other[order], np.full(len(order), incoming), kind[order], syms])
            cut()
        if best:
            node, _, other, outgoing, kind, syms = best[0]
            nodes, kinds, symbols = pa.array(p.nodes, pa.string()), pa.array(p.kinds, pa.string()), pa.array(p.symbols, pa.string())
            offsets, flat = np.concatenate([[0], np.cumsum([len(s) for s in syms])]).astype(np.int32), np.array([x for s in syms for x in s], np.int32)
            yield [nodes.take(pa.array(node)), nodes.take(pa.array(other)), pa.array(["incoming", "outgoing"]).take(pa.array(outgoing)), kinds.take(pa.array(kind)), pa.ListArray.from_arrays(pa.array(offsets), symbols.take(pa.array(flat)))]

    ddl = "repo string, path string, other string, direction string, kind string, symbols array<string>"
    found = _each(parts, make, ddl)
    if only is not None:
        loop = parts.filter("loop")
        few = only.join(loop.filter("part = 0").select(F.col("repo").alias("_l")), F.col("repo") == F.col("_l"), "left_semi")
        few = few.groupBy(F.col("repo").alias("_o")).agg(F.collect_set("path").alias("only"))
        found = _each(parts.filter("not loop"), make, ddl).unionByName(_each(loop.join(F.broadcast(few), F.col("repo") == F.col("_o")), make, ddl, "only"))
        o = only.select(F.col("repo").alias("_r"), F.col("path").alias("_p"))
        found = found.join(o, (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")), "left_semi")
    order = Window.partitionBy("repo", "path").orderBy(F.desc(F.size("symbols")), F.lower("other"), "direction", "kind", "other")
    return found.select("repo", "path", F.row_number().over(order).alias("k"), "other", "direction", "kind", "symbols").filter(F.col("k") <= limit)


SCORES = "repo string, path string, known boolean, value double, top_value double, near double, top_near double, score double, top_score double"


def _scored(p: Part, near: np.ndarray, score: np.ndarray) -> list:
    top = lambda x: np.full(p.n, x.max() if p.n else 0.0)
    return [pa.array(p.nodes, pa.string()), p.known, p.value, top(p.value), near, top(near), score, top(score)]


def _share(x: np.ndarray) -> np.ndarray:
    """As ``rank.max_normalised``."""
    return x / x.max() if len(x) and x.max() > 0 else np.zeros(len(x))


def scores(parts: DataFrame, personal: bool = False, near: bool = False, alpha: float = ALPHA, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE, rank: bool = True) -> DataFrame:
    """Every node with its file's value, the value spread over two hops and PageRank; written once.

    ``known`` is whether it is a file, ``near`` is spread from values divided by their greatest, ``score`` is
    personalized by values if ``personal``; the ``top_`` columns have the repository's greatest. What is not
    asked for is 0.
    """

    def whole(p: Part) -> Iterator[list]:
        spread, x = np.zeros(p.n), np.zeros(p.n)
        if near:
            spread = p.near(_share(p.value))
        if rank:
            src, dst, w = (np.concatenate(c) for c in zip(*p.weights(), (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)), strict=True))
            x = power_iteration(p.start(personal), src, dst, w, alpha, max_steps, tolerance)
        yield _scored(p, spread, x)

    out = _each(parts.filter("not loop"), whole, SCORES)
    if not parts.filter("loop").isEmpty():
        out = out.unionByName(_stepwise(parts.filter("loop"), personal, near, alpha, max_steps, tolerance, rank))
    return materialize(out, "scores")


# Repositories in several parts: their vectors move, 8 bytes a node, not their edges.

VECTORS = "repo string, part int, x binary, p binary, extra double, stop boolean"


def _stepwise(parts: DataFrame, personal: bool, near: bool, alpha: float, max_steps: int, tolerance: float, rank: bool) -> DataFrame:
    spark = parts.sparkSession
    first = parts.filter("part = 0")
    links = materialize(parts.mapInArrow(_prepare, PARTS), "links")
    found: list[tuple[str, DataFrame]] = []
    if near:
        state = materialize(_vectors(first, lambda p: (_share(p.value), None)), "near")
        found.append(("near0", state))
        for k in range(2):
            state = materialize(_updated(_swept(links, state, _spread), state, lambda old, p, got, extra: (np.maximum.reduce(got) * DECAY, False)), "near")
            found.append((f"near{k + 1}", state))
    done = None
    if rank:
        state, done = materialize(_vectors(first, lambda p: (p.start(personal), p.start(personal))), "pagerank"), scratch_dir(spark, "ranks")
        for k in range(max_steps):
            last = k == max_steps - 1

            def new(old: np.ndarray, p: np.ndarray, got: list[np.ndarray], sent: float, last: bool = last) -> tuple[np.ndarray, bool]:
                x = (1 - alpha) * p + alpha * np.sum(got, axis=0) + alpha * max(0.0, old.sum() - sent) * p
                return x, last or bool(np.abs(x - old).sum() < len(x) * tolerance)

            now = materialize(_updated(_swept(links, state, _sent), state, new), "pagerank")
            discard(state)
            stopped, moving = now.agg(F.count_if("stop"), F.count_if(~F.col("stop"))).first()  # two numbers
            if stopped:
                now.filter("stop").select("repo", "x").write.mode("append").parquet(done)
            state = materialize(now.filter("not stop"), "pagerank") if stopped and moving else now
            if state is not now:
                discard(now)
            if not moving:
                break
        discard(state)
    joined = first.select("repo", "blob")
    for name, s in found:
        joined = joined.join(s.select(F.col("repo").alias(f"_{name}"), F.col("x").alias(name)), F.col("repo") == F.col(f"_{name}"))
    if done:
        joined = joined.join(spark.read.schema("repo string, x binary").parquet(done).withColumnRenamed("repo", "_x"), F.col("repo") == F.col("_x"))
    names = [name for name, _ in found]
    joined = joined.select("blob", *names, *(["x"] if done else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(SCORES)
        for b in batches:
            for r in b.to_pylist():
                p = Part.unpack(r["blob"])
                spread = np.maximum.reduce([np.frombuffer(r[c]) for c in names]) if names else np.zeros(p.n)
                x = np.frombuffer(r["x"]) if rank else np.zeros(p.n)
                columns = _scored(p, spread, x / x.sum() if x.sum() > 0 else x)
                yield pa.RecordBatch.from_arrays([pa.array([p.repo] * p.n, pa.string()), *[pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    out = materialize(joined.mapInArrow(run, SCORES), "stepwise")
    for d in [links, *[s for _, s in found]]:
        discard(d)
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts without paths and symbols. Rows of a source and kind meet those that ask for the same sets: a
    *signature*, whose union of sets is what one rank is sent to at once."""
    for b in batches:
        for row in b.to_pylist():
            p = Part.unpack(row["blob"])
            w, signatures, rows, seen = p.kind_weights(), {}, [], np.zeros(p.n, bool)
            sizes: list[int] = []
            pair = p.src.astype(np.int64) * max(1, len(p.kinds)) + p.kind
            order = np.argsort(pair, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
                src, hubs = int(p.src[group[0]]), tuple(np.unique(p.hub[group]).tolist())
                sets = [p.ids[p.off[h] : p.off[h + 1]] for h in hubs]
                if hubs not in signatures:
                    signatures[hubs] = len(signatures)
                    for s in sets:
                        seen[s] = True
                    sizes.append(int(np.count_nonzero(seen)) if len(hubs) > 1 else len(sets[0]))
                    for s in sets:
                        seen[s] = False
                own = any(s[i] == src for s in sets if (i := np.searchsorted(s, src)) < len(s))
                if sizes[signatures[hubs]] > own:
                    rows.append((src, signatures[hubs], w[p.kind[group[0]]], own))
            src, sig, wk, own = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.int32, np.int32, float, bool)))
            out = np.bincount(src, wk * (np.array(sizes, float)[sig] - own), p.n) if rows else np.zeros(p.n)
            made = Part(n_nodes=p.n, src=p.src, hub=p.hub, off=p.off, ids=p.ids, sig_src=src, sig=sig, sig_share=wk / out[src] if rows else wk, sig_own=own, sig_hubs=list(signatures))
            yield pa.RecordBatch.from_pylist([{"repo": row["repo"], "part": row["part"], "loop": True, "blob": made.pack()}], _schema(PARTS))


def _sent(p: Part, x: np.ndarray) -> tuple[np.ndarray, float]:
    """What ranks ``x`` send along the edges of a part, and the ranks of the nodes that send."""
    got, one, mask = np.zeros(len(x)), np.zeros(len(p.off) - 1), np.zeros(len(x))
    each = x[p.sig_src] * p.sig_share
    if len(each):
        for hubs, c in zip(p.sig_hubs, np.bincount(p.sig, each, len(p.sig_hubs)).tolist(), strict=True):
            if len(hubs) == 1:
                one[hubs[0]] += c
            elif c:
                sets = [p.ids[p.off[h] : p.off[h + 1]] for h in hubs]
                if sum(map(len, sets)) * 16 < len(x):
                    got[np.unique(np.concatenate(sets))] += c
                else:
                    for s in sets:
                        mask[s] = c
                    got += mask
                    for s in sets:
                        mask[s] = 0.0
        got += np.bincount(p.ids, np.repeat(one, np.diff(p.off)), len(x))
        got -= np.bincount(p.sig_src, each * p.sig_own, len(x))
    return got, float(x[np.unique(p.sig_src)].sum())


def _spread(p: Part, x: np.ndarray) -> tuple[np.ndarray, float]:
    return _hop(x, p.src, p.hub, p.off, p.ids), 0.0


def _vectors(first: DataFrame, make: Callable[[Part], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob"):
                part = Part.unpack(blob.as_py())
                x, p = make(part)
                yield pa.RecordBatch.from_pylist([{"repo": part.repo, "part": -1, "x": x.tobytes(), "p": None if p is None else p.tobytes(), "extra": 0.0, "stop": False}], _schema(VECTORS))

    return first.select("blob").mapInArrow(run, VECTORS)


def _swept(links: DataFrame, state: DataFrame, make: Callable[[Part, np.ndarray], tuple[np.ndarray, float]]) -> DataFrame:
    """``make`` over all parts with their repository's vector, what a task has of a repository in one row.

    The parts stay where they are and the vectors are broadcast: 8 bytes a node of the repositories in parts.
    """
    add = make is _sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for b in batches:
            for r in b.to_pylist():
                got, extra = make(Part.unpack(r["blob"]), np.frombuffer(r["x"]))
                old = sums.setdefault(r["repo"], [np.zeros(len(got)), 0.0])
                old[0] = old[0] + got if add else np.maximum(old[0], got)
                old[1] += extra
        for repo, (x, extra) in sums.items():
            yield pa.RecordBatch.from_pylist([{"repo": repo, "part": 0, "x": x.tobytes(), "p": None, "extra": extra, "stop": False}], _schema(VECTORS))

    vector = F.broadcast(state.select(F.col("repo").alias("_v"), "x"))
    return links.join(vector, F.col("repo") == F.col("_v")).select("repo", "blob", "x").mapInArrow(run, VECTORS)


def _updated(partial: DataFrame, state: DataFrame, new: Callable) -> DataFrame:
    """The next state: of every repository its old row (part -1) and its partial ones."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        old = next(r for r in rows if r["part"] == -1)
        got = [np.frombuffer(r["x"]) for r in rows if r["part"] != -1]
        p = np.frombuffer(old["p"]) if old["p"] is not None else None
        x, stop = new(np.frombuffer(old["x"]), p, got, sum(r["extra"] for r in rows))
        return pa.Table.from_pylist([{"repo": old["repo"], "part": -1, "x": x.tobytes(), "p": old["p"], "extra": 0.0, "stop": stop}], _schema(VECTORS))

    return state.unionByName(partial).groupBy("repo").applyInArrow(run, VECTORS)
