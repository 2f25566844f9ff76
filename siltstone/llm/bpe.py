"""Encoding of whole texts by a byte-level BPE vocabulary, as a streaming transducer.

The merge list is analysed once for its sufficient lookahead: the number of bytes to the right of
a position that can still change what is merged left of it. While a piece of text streams in, only
a window is held; tokens that end further from the window's end than the lookahead are stable and
are emitted, so memory stays constant however long a text or a piece is.

Why the lookahead is bounded: a merge ``(b, c)`` is undone by the text to the right only if a merge
of higher priority takes ``c``, or a symbol on the right edge of what becomes ``c``, first; whether
that one happens depends in turn on a merge of still higher priority further right. Priorities
strictly rise along such a chain, so the longest chain, in bytes, bounds the influence.

Every text runs through ``Encoder`` and every piece that is no token as a whole through
``PieceTransducer``, whatever their lengths. Most pieces are short words that come again and again,
so what the transducer gave for a piece is kept in a bounded table in each worker.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the public vocabulary's texts are cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECE = regex.compile(PIECES)
# What can go on in an open piece, by the class of its last character.
_GO_ON = (regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"\s+"), regex.compile(r"[^\s\p{L}\p{N}]+"))

TABLE_SIZE = 400_000
HELD_CHARS = 256
CHUNK_CHARS = 1 << 16


class Vocabulary:
    """Token ids by bytes; ids are merge priorities."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.lookahead = self._lookahead()

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one, or none for a single byte."""
        if token not in self._parts:
            left = self.merge(token, below=self.ids[token]) if len(token) > 1 else [token]
            self._parts[token] = (left[0], left[1]) if len(left) == 2 else None
        return self._parts[token]

    def _lookahead(self) -> int:
        reach: dict[bytes, int] = {}  # bytes a chain can reach that begins with a merge whose left side is the key
        most = 0
        for token, _ in sorted(self.ids.items(), key=lambda x: x[1]):
            if not (pair := self.parts(token)):
                continue
            left, right = pair
            edge: bytes | None = right
            beyond = 0
            while edge is not None:
                beyond = max(beyond, reach.get(edge, 0))
                inner = self.parts(edge)
                edge = inner[1] if inner else None
            here = len(right) + beyond
            most = max(most, here)
            reach[left] = max(reach.get(left, 0), here)
        return most + self.longest

    def merge(self, text: bytes, below: int = 1 << 60) -> list[bytes]:
        """All merges of a byte string, by priority and from the left; with ``below`` only merges of higher priority."""
        ids, n = self.ids, len(text)
        if n < 2:
            return [text] if n else []
        if below == 1 << 60 and text in ids and n <= 2:
            return [text]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ids.get(text[i : i + 2])
            if r is not None and r < below:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ids.get(text[i : end[k]])
                if r is not None and r < below:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0:
                r = ids.get(text[h:stop])
                if r is not None and r < below:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(text[i : end[i]])
            i = after[i]
        return out


class PieceTransducer:
    """Encodes one piece whose bytes arrive bit by bit; emits ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, window: int = 0):
        self.v = vocabulary
        self.window = max(window, 2 * vocabulary.lookahead)
        self.held = b""
        self.pieces = 0  # finished so far

    def feed(self, more: bytes) -> Iterator[int]:
        for at in range(0, len(more), self.window):
            self.held += more[at : at + self.window]
            if len(self.held) >= self.window:
                done = 0
                for token in self.v.merge(self.held):
                    if done + len(token) + self.v.lookahead > len(self.held):
                        break
                    done += len(token)
                    yield self.v.ids[token]
                self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        for token in self.v.merge(self.held):
            yield self.v.ids[token]
        self.held = b""
        self.pieces += 1


class _Pieces(dict):
    """Ids of whole pieces as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.transducer = PieceTransducer(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= TABLE_SIZE:
            self.clear()
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.v.ids.get(raw)
        ids = [whole] if whole is not None else [*self.transducer.feed(raw), *self.transducer.finish()]
        out = np.array(ids, "<i4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """Text arrives in any portions; the ids come out in order as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pieces: _Pieces):
        self.v, self.pieces = vocabulary, pieces
        self.held = ""
        self.open: PieceTransducer | None = None
        self.go_on: regex.Pattern | None = None

    def feed(self, text: str) -> bytes:
        out = []
        if self.open:
            text, self.held = self.held + text, ""
            m = self.go_on.match(text)
            run = m.end() if m else 0
            blank = self.go_on is _GO_ON[2]
            if run == len(text):  # the piece may go on; of blanks the last may belong to the next piece
                keep = 1 if blank else 0
                self.held = text[run - keep :] if keep else ""
                return self._emit(text[: run - keep])
            if blank and run and not text[run].isspace():
                run -= 1
            out.append(self._emit(text[:run]))
            out.append(np.array([*self.open.finish()], "<i4").tobytes())
            self.open, text = None, text[run:]
        text = self.held + text
        found = _PIECE.findall(text)
        # A piece at the end may grow, and an apostrophe before it may yet begin a contraction.
        tail = found[-2:]
        size = sum(map(len, tail))
        out += map(self.pieces.__getitem__, found[: len(found) - len(tail)])
        self.held = text[len(text) - size :] if size else ""
        if tail and len(tail[-1]) > HELD_CHARS:
            out += map(self.pieces.__getitem__, tail[:-1])
            last = tail[-1]
            self.go_on = next(p for p in _GO_ON if p.match(last[-1]))
            self.open = PieceTransducer(self.v)
            keep = 1 if last[-1].isspace() else 0
            self.held = last[len(last) - keep :] if keep else ""
            out.append(self._emit(last[: len(last) - keep]))
        return b"".join(out)

    def _emit(self, text: str) -> bytes:
        return np.array([*self.open.feed(text.encode("utf-8", "surrogatepass"))], "<i4").tobytes()

    def finish(self) -> bytes:
        if self.open:
            last = self._emit(self.held) + np.array([*self.open.finish()], "<i4").tobytes()
        else:
            last = b"".join(map(self.pieces.__getitem__, _PIECE.findall(self.held)))
        self.held, self.open = "", None
        return last


class Tokenizer:
    """One vocabulary with its table of pieces; encodes whole texts and decodes ids bit by bit."""

    def __init__(self, path: str = DEFAULT_RANKS):
        self.v = Vocabulary(path)
        self.pieces = _Pieces(self.v)
        self.encoder = Encoder(self.v, self.pieces)

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = [self.encoder.feed(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)]
        return b"".join([*out, self.encoder.finish()])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete; at most three bytes are held."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if got := machine.decode(self.v.bytes_of[i]):
                yield got
        if got := machine.decode(b"", True):
            yield got

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=4)
def tokenizer(path: str = DEFAULT_RANKS) -> Tokenizer:
    """The worker's tokenizer for a vocabulary file, at its own path or as ``send`` brought it."""
    return Tokenizer(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


_sent: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file of the driver's to the executors, once a session; they need not have it themselves."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent and os.path.exists(path):
        _sent.add(key)
        spark.sparkContext.addFile(path)


def encode_batch(t: Tokenizer, texts: pa.Array) -> pa.ListArray:
    """A list of ids for every text, an empty one for null."""
    packed = [t.encode_packed(x) for x in texts.to_pylist()]
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Token ids of every text: ``<id_col>, ids``, without special tokens and without a shuffle.

    Defined cases: null and empty texts give an empty list; blank texts have their tokens; strings
    of special tokens are ordinary text; repeated rows and null ids pass through as they come; other
    columns are ignored; an empty table gives an empty result. The vocabulary file is sent to executors
    that have none at its path.
    """
    send(documents.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks)
        for b in batches:
            yield pa.record_batch([b.column(0), encode_batch(t, b.column(1))], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")

