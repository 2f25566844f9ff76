"""Text garbled by decoding with the wrong encoding: finding, naming the chain, restoring.

A multinomial classifier over hashed byte bigrams is trained on all distinct texts: their words as
they stand make the class ``clean``, the same words garbled through every encoding chain make the
other classes, and what a first round finds garbled is taken out of both. A text is judged by a class
``clean`` without an eighth of the texts that it is part of, so that it does not speak for itself. A word is scored by how much likelier each chain makes it than
``clean``; a text's best passage for a chain is the stretch of its words with the greatest sum, so
one garbled sentence in a long text is found as well as a wholly garbled text. The predicted chain
is inverted, which must succeed strictly byte for byte, and the result must read better than what
stood there. The words and character bigrams that decide are counted over all clean texts too: bigrams
of the encodings' own characters in one bounded table, words and all other bigrams in a table that is
joined to the texts in question.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

DIMENSIONS = 1 << 15
LAGS = (1, 2, 3)
FOLDS = 8  # parts of the texts; a text is compared with the clean words of the others
SEEN = 200_000  # texts a task remembers, to pass over copies before anything moves
INSIDE, OUTSIDE = -1, -2  # in place of a feature, for character pairs
LOSSY = "utf-8 read failed"
LOST = "\ufffd"

# Chains as (bytes written as, read as) steps from the true text on.
_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp850", "cp437", "mac_roman", "iso8859-2", "iso8859-15", "cp1254")
_SINGLE = (
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"),
    ("iso8859-2", "latin-1"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1250", "cp852"), ("cp852", "cp1250"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
    ("cp1250", "cp850"), ("cp1250", "mac_roman"), ("cp852", "cp1252"),
)
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {f"utf-8>{x}": (("utf-8", x),) for x in _READ_AS}
CHAINS |= {f"utf-8>{x}>utf-8>{y}": (("utf-8", x), ("utf-8", y)) for x in ("cp1252", "latin-1") for y in ("cp1252", "latin-1")}
CHAINS |= {f"utf-8>{x}>utf-8>{x}": (("utf-8", x), ("utf-8", x)) for x in ("cp1250", "cp1251", "mac_roman", "cp850")}
CHAINS |= {"utf-8>cp1252 three times": (("utf-8", "cp1252"),) * 3}
CHAINS |= {f"{a}>{b}": ((a, b),) for a, b in _SINGLE}
NAMES = ["clean", LOSSY, *CHAINS]


@lru_cache(maxsize=64)
def _tables(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; undefined bytes stand for themselves, as lenient readers have it."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as it looks after the chain; none if a character cannot be written in the chain's encoding."""
    for written, read in chain:
        try:
            raw = text.encode(written)
        except UnicodeEncodeError:
            return None
        chars = _tables(read)[0]
        text = "".join([chars[b] for b in raw])
    return text


# Pairs of these characters travel with the model; there are at most some 700 of them. Counts of other pairs are joined.
ALPHABET = frozenset(chr(b) for b in range(128)) | {c for steps in CHAINS.values() for step in steps for e in step if e != "utf-8" for c in _tables(e)[0]}


def word_key(word: str) -> str:
    """The word, or for a long one its digest: what words are counted by."""
    return word if len(word) <= 64 else hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def pair_key(pair: str) -> str:
    """What pairs beyond ``ALPHABET`` are counted by, beside the words, none of which has a blank."""
    return f" {pair}"


def _odd_pairs(word: str) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + 2] for i in range(len(framed) - 1) if framed[i] > "\x7f" or framed[i + 1] > "\x7f"]


@lru_cache(maxsize=64)
def _utf8_runs(read: str) -> re.Pattern:
    """Characters that are a whole UTF-8 sequence when written back in ``read``."""
    chars = _tables(read)[0]
    of = lambda a, b: "[" + "".join(re.escape(chars[x]) for x in range(a, b)) + "]"
    tail = of(0x80, 0xC0)
    return re.compile(f"{of(0xC2, 0xE0)}{tail}|{of(0xE0, 0xF0)}{tail}{tail}|{of(0xF0, 0xF5)}{tail}{tail}{tail}")


def _undo_utf8(text: str, read: str) -> str:
    back = _tables(read)[1]

    def one(m: re.Match) -> str:
        try:
            return bytes(back[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _utf8_runs(read).sub(one, text)


def invert(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word before the chain, or none where its bytes do not decode strictly."""
    for written, read in reversed(chain):
        if written == "utf-8":
            undone = _undo_utf8(word, read)
            if undone == word:
                return None
            word = undone
        else:
            back = _tables(read)[1]
            try:
                word = bytes(back[c] for c in word).decode(written)
            except (KeyError, UnicodeDecodeError):
                return None
    return word


# Words end at ASCII blanks only: a garbled text may hold U+0085 and U+00A0 inside its words.
_WORD = re.compile(r"[^ \t\r\n\f\v]+")
_ODD = re.compile(r"[^\x00-\x7f][^ \t\r\n\f\v]*")


def odd_words(text: str) -> list[tuple[int, int]]:
    """Spans of the words with a character beyond ASCII, in order."""
    blanks = [c for c in " \t\r\n\f\v" if c in text]
    out, done = [], 0
    for m in _ODD.finditer(text):
        i, end = m.span()
        out.append((max([done - 1, *[text.rfind(c, done, i) for c in blanks]]) + 1, end))
        done = end
    return out


def odd_word_list(text: str) -> list[str]:
    """The same words without their places."""
    for c in "\t\r\n\f\v":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if not w.isascii()]


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams of blank-framed words: feature and word of each occurrence."""
    raws = [f" {w} ".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    feats, owners = [], []
    for lag in LAGS:
        a, b, o, p = data[:-lag], data[lag:], owner[:-lag], owner[lag:]
        keep = (o == p) & ((a > 127) | (b > 127))
        code = (a[keep] << 8 | b[keep]) * 4 + lag
        feats.append((code * 0x9E3779B1 >> 7) % DIMENSIONS)
        owners.append(o[keep])
    return np.concatenate(feats), np.concatenate(owners)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fold_of(text: str) -> int:
    return _digest(text)[0] % FOLDS


def tally(words: list[str], ns: list[int], fitted: np.ndarray) -> tuple[np.ndarray, Counter]:
    """Hashed byte bigrams of words that occur ``fitted`` times in each fold; character pairs of words that occur ``ns`` times.

    There is a row of features for each of ``NAMES``, then one for the clean words of each fold.

    Words with a lost character are left out. Both are sums over the words, so those of parts add up.
    """
    counts = np.zeros((len(NAMES) + FOLDS, DIMENSIONS), np.int64)
    clean = [i for i, w in enumerate(words) if LOST not in w]
    pairs: Counter = Counter()
    for i in clean:
        for p in _odd_pairs(words[i]):
            pairs[p] += ns[i]
    totals = fitted.sum(1)
    clean = [i for i in clean if totals[i]]
    used = [(words[i], totals[i]) for i in clean]
    for k, name in enumerate(NAMES):
        if name == "clean":
            made = used
        elif name == LOSSY:
            made = [(m, n) for w, n in used if (m := w.encode("cp1252", "replace").decode("utf-8", "replace")) != w]
        else:
            made = [(m, n) for w, n in used if (m := garble(w, CHAINS[name])) is not None and m != w]
        if made:
            f, o = _features([m for m, _ in made])
            counts[k] = np.bincount(f, np.array([n for _, n in made], np.float64)[o], DIMENSIONS)
            if k == 0:
                for fold in range(FOLDS):
                    counts[len(NAMES) + fold] = np.bincount(f, fitted[clean, fold].astype(np.float64)[o], DIMENSIONS)
    return counts, pairs


class Model:
    """Log-likelihood ratios of hashed byte bigrams for every chain against clean, and clean character bigrams."""

    def __init__(self) -> None:
        self.weights = np.zeros((DIMENSIONS, len(NAMES) + FOLDS), np.float32)
        self.fold: int | None = None
        self.bigrams: dict[str, float] = {}
        self.floor = 0.0
        self.words: dict[str, int] = {}
        self.own: dict[str, int] = {}
        self.own_pairs: dict[str, int] = {}
        self.known: set[str] | None = None
        self.total = 1.0
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._table = np.zeros((1024, len(NAMES) + FOLDS), np.float32)
        self._undone: dict[tuple[str, str], str | None] = {}

    def fit(self, texts: list[str]) -> Model:
        """Two rounds: what the first finds garbled leaves the clean class of the second."""
        kept = [t for t in texts if t]
        self._fit(kept)
        self._fit([t for t in kept if self.judge(t) is None])
        return self

    def _fit(self, texts: list[str]) -> None:
        words: dict[str, list[int]] = {}
        for t in texts:
            fold = fold_of(t)
            for w in odd_word_list(t):
                words.setdefault(w, [0] * FOLDS)[fold] += 1
        counts, pairs = tally([*words], [sum(n) for n in words.values()], np.array([*words.values()], np.int64).reshape(-1, FOLDS))
        self.learn(counts, pairs, sum(pairs.values()))
        self.words = Counter({word_key(w): sum(n) for w, n in words.items()})

    def learn(self, counts: np.ndarray, pairs: dict[str, int], total: int) -> None:
        """Set the weights by the features of ``tally`` and the rates of pairs by their number among ``total``; the counts of others come with the words."""
        smooth = 0.2
        counts = np.vstack([counts[: len(NAMES)], counts[0] - counts[len(NAMES) :]])  # what is clean without each fold
        logs = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * DIMENSIONS))
        self.weights = np.ascontiguousarray((logs - logs[0]).T.astype(np.float32))
        self._forget()
        self.total = total + 1.0
        self.bigrams = {p: float(np.log(n / self.total)) for p, n in pairs.items()}
        self.floor = float(np.log(0.02 / self.total))

    def scores(self, words: list[str], fold: int | None) -> np.ndarray:
        """The words' log-likelihood ratios, one column a chain, against what is clean without the fold."""
        row = self._row
        fresh = list({w for w in words if w not in row})
        if fresh:
            if len(row) + len(fresh) > 200_000:
                row.clear()
                fresh = list(set(words))
            f, o = _features(fresh)
            out = np.zeros((len(fresh), len(NAMES) + FOLDS), np.float32)
            np.add.at(out, o, self.weights[f])
            n = np.bincount(o, minlength=len(fresh))[:, None]
            at = len(row)
            while at + len(fresh) > len(self._table):
                self._table = np.vstack([self._table, np.zeros_like(self._table)])
            self._table[at : at + len(fresh)] = out / np.maximum(n, 1) * 4  # a word counts alike however long its garbling made it
            row.update((w, at + i) for i, w in enumerate(fresh))
        got = self._table[[row[w] for w in words]]
        return got[:, : len(NAMES)] if fold is None else got[:, : len(NAMES)] - got[:, len(NAMES) + fold, None]

    @staticmethod
    def stretches(s: np.ndarray) -> np.ndarray:
        """The greatest sum over a stretch of words, for all chains at once."""
        upto = np.zeros((len(s) + 1, s.shape[1]))
        np.cumsum(s, axis=0, out=upto[1:])
        return (upto - np.minimum.accumulate(upto, axis=0)).max(0)

    def in_question(self, text: str) -> bool:
        """Whether the classifier holds any chain possible for a text."""
        words = odd_word_list(text)
        return bool(words) and bool((self.stretches(self.scores(words, fold_of(text)))[1:] >= LEAST_SCORE).any())

    def predict(self, text: str) -> tuple[str, str] | None:
        """By the classifier alone: the chain of the best stretch and the text with that stretch inverted, if all of it decodes strictly."""
        words = odd_word_list(text)
        if not words:
            return None
        spans = odd_words(text)
        s = self.scores(words, fold_of(text))
        sums = self.stretches(s)
        k = int(np.argmax(sums[1:])) + 1
        if sums[k] < LEAST_SCORE:
            return None
        if NAMES[k] == LOSSY:
            return LOSSY, text
        upto = np.r_[0.0, np.cumsum(s[:, k])]
        end = int(np.argmax(upto - np.minimum.accumulate(upto)))
        start = int(np.argmin(upto[:end])) if end else 0
        out, done = [], 0
        for (a, b), w in list(zip(spans, words))[start:end]:
            back = self.undo(w, NAMES[k])
            if back is None:
                return None
            out += [text[done:a], back]
            done = b
        return NAMES[k], "".join([*out, text[done:]])

    def undo(self, word: str, name: str) -> str | None:
        """``invert``, kept for words that come again."""
        key = (word, name)
        if key not in self._undone:
            if len(self._undone) > 200_000:
                self._undone.clear()
            self._undone[key] = invert(word, CHAINS[name])
        return self._undone[key]

    def reads(self, word: str) -> float:
        """Log-likelihood of a word's characters beyond ASCII, per character pair of clean text."""
        total = 0.0
        for p in _odd_pairs(word):
            rate = self.bigrams.get(p)
            if rate is None and (n := self.words.get(pair_key(p))):
                rate = math.log(n / self.total)
            if rate is not None and p in self.own_pairs:
                rate = math.log(max(math.exp(rate) * self.total - self.own_pairs[p], 0.02) / self.total)
            total += rate if rate is not None else self.floor
        return total

    def judge(self, text: str) -> tuple[str, str, bool] | None:
        """The chains, the restored text and whether all of it was restored, or none for a clean text."""
        if not self.in_question(text):
            return None
        chains, restored, _ = self.restore(text, self.words, True)
        return (", ".join(dict.fromkeys(chains)), restored, LOST not in restored) if chains else None

    def restore(self, text: str, counts: dict[str, int], complete: bool, first: bool = True) -> tuple[list[str], str, bool]:
        """The chains, the text without them, and whether counts of further words are needed to go on.

        ``counts`` are of all words where ``complete``, else of the words the text has now and of their
        originals and of the pairs beyond ``ALPHABET`` in both, what never occurs left out. ``first`` tells that the text is as it was counted, so
        that its own words do not speak for themselves. A step undoes one chain, at one passage if it is
        of one-byte encodings; steps go on until nothing is found.
        """
        self._begin(text, counts, complete, first)
        chains: list[str] = []
        made: set[str] = set()
        if first and self._lossy(text):
            chains.append(LOSSY)
        seen = {text}
        while text and not text.isascii():
            got = self._step(text, made)
            if got is None:
                break
            if not got[0]:
                return chains, text, True
            if got[1] in seen:
                break
            chains.append(got[0])
            text = got[1]
            seen.add(text)
        return chains, text, bool(made) and not complete

    def garbled(self, text: str, counts: dict[str, int]) -> bool:
        """Whether ``restore`` finds anything in a text as it was counted."""
        self._begin(text, counts, False, True)
        return self._lossy(text) or self._step(text, set()) is not None

    def _begin(self, text: str, counts: dict[str, int], complete: bool, first: bool) -> None:
        self.words = counts
        here = odd_word_list(text)
        self.known = None if complete else set(here)
        self.own = Counter(map(word_key, here)) if first else {}
        self.fold = fold_of(text) if first else None

    def _lossy(self, text: str) -> bool:
        """Whether the classifier holds some words with a lost character for what a failed reading leaves."""
        words = [w for w in odd_word_list(text) if LOST in w] if LOST in text else []
        return bool(words) and bool(self.stretches(self.scores(words, self.fold))[NAMES.index(LOSSY)] >= LEAST_SCORE)

    def _known(self, word: str) -> bool:
        return self.known is None or word in self.known

    def _readable(self, word: str, back: str) -> bool:
        """Whether the rates of the pairs of both are at hand."""
        return self._known(word) or (ALPHABET.issuperset(word) and ALPHABET.issuperset(back))

    def _step(self, text: str, made: set[str]) -> tuple[str, str] | None:
        """The next chain and the text restored from it, an empty chain where words have to be counted, or none for a clean text.

        Words in ``made`` were restored just now; as long as they are not counted they stay.
        """
        spans = odd_words(text)
        words = [text[a:b] for a, b in spans]
        s = self.scores(words, self.fold)
        sums = self.stretches(s)
        for k in np.argsort(-sums):
            if sums[k] < LEAST_SCORE:
                break
            name = NAMES[k]
            if name in ("clean", LOSSY):
                continue
            if CHAINS[name][0][0] == "utf-8":
                # Judged word by word: only what the classifier holds likelier after the chain is inverted.
                likely = [i for i in np.flatnonzero(s[:, k] > 0).tolist() if (back := self.undo(words[i], name)) is not None and back != words[i] and self._readable(words[i], back)]
                gains = {i: self.reads(self.undo(words[i], name)) - self.reads(words[i]) for i in likely}
                if sum(g for g in gains.values() if g > 0) < LEAST_GAIN:
                    continue
                chosen = {i: self.undo(words[i], name) for i, g in gains.items() if g > 0}
            else:
                if any(w not in made and not self._known(w) for w in words):
                    return "", text
                chosen = self._passage(text, spans, words, name)
            if not chosen:
                continue
            out, done = [], 0
            for i, back in sorted(chosen.items()):
                out += [text[done : spans[i][0]], back]
                done = spans[i][1]
                made.update(_WORD.findall(back))
            return name, "".join([*out, text[done:]])
        return None

    def _passage(self, text: str, spans: list[tuple[int, int]], words: list[str], name: str) -> dict[int, str]:
        """The words of the best passage that went through a chain of one-byte encodings, with their originals; none if it is too weak."""
        # A passage went through the chain as a whole, so words that cannot come from it break it. Words with a lost character say nothing.
        backs = [w if LOST in w or not self._known(w) else self.undo(w, name) for w in words]
        gains = [self.gain(w, back) for w, back in zip(words, backs)]
        best, start, run, at = 0.0, 0, 0.0, 0
        end = 0
        for i, g in enumerate(gains):
            run += g
            if run <= 0:
                run, at = 0.0, i + 1
            elif run > best:
                best, start, end = run, at, i + 1
        if best:  # a passage hardly ends within a few characters of a word that contradicts it
            for i, near in ((start - 1, start), (end, end - 1)):
                if 0 <= i < len(words) and gains[i] < 0:
                    gap = spans[near][0] - spans[i][1] if i < near else spans[i][0] - spans[near][1]
                    best -= CONTRADICTED if gap <= 12 else 0.0
        if best < LEAST_SINGLE:
            return {}
        if best >= SURE:  # words at its ends that may as well be right as they stand belong to a sure passage
            fits = lambda i: backs[i] is not None and gains[i] > -3.0
            while end < len(words) and fits(end):
                end += 1
            while start > 0 and fits(start - 1):
                start -= 1
        return {i: backs[i] for i in range(start, end) if backs[i] is not None and backs[i] != words[i]}

    def gain(self, word: str, back: str | None) -> float:
        """How much speaks for ``back`` having become ``word`` by a chain of one-byte encodings.

        After such a chain any byte is possible, so words decide: garbled, a word comes far more rarely than its original.
        """
        if back is None:
            return -6.0
        if back == word:
            return 0.0
        key = word_key(word)
        own = self.own.get(key, 0)
        here, there = max(0, self.words.get(key, 0) - own), self.words.get(word_key(back), 0)
        told = math.log((there * MOST_RATE + 0.01) / (here + 0.3))
        if here <= 2 and there * MOST_RATE < RARE:
            # Too rare for their rates to tell: the characters decide, and each occurrence of the original adds to them.
            if own and self.words.get(key, 0):  # a garbled word missed by the first judgement was counted, and must not speak for itself
                self.own_pairs = {p: n * own for p, n in Counter(_odd_pairs(word)).items()}
            better = self.reads(back) - self.reads(word)
            self.own_pairs = {}
            read = min(2.0, max(-3.0, 0.3 * better + (0.5 * math.log1p(there) if better > 0 else 0.0)))
            return max(told, read) if there else read
        return told


LEAST_SINGLE = 1.5
CONTRADICTED = 1.5
SURE = 6.0
MOST_RATE = 0.05  # the share of a word's occurrences that one chain garbled is taken to be below this
RARE = 1.4
LEAST_SCORE = 3.0
LEAST_GAIN = 4.0


def _texts(documents: DataFrame, text_col: str) -> DataFrame:
    """``digest, fold, words``: the words beyond ASCII of every text that has any; a task gives copies of a text once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, words = [], []
            for text in b.column(0).to_pylist():
                if not text or text.isascii():
                    continue
                digest = _digest(text)
                if digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                digests.append(digest)
                words.append(odd_word_list(text))
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array([d[0] % FOLDS for d in digests], pa.int32()), pa.array(words, pa.list_(pa.string()))], ["digest", "fold", "words"])

    return documents.select(F.col(text_col).cast("string")).mapInArrow(run, "digest binary, fold int, words array<string>")


def _asked(documents: DataFrame, id_col: str | None, text_col: str, shared) -> DataFrame:
    """``_id, text`` of the texts the classifier puts in question, ``_id`` being the text's digest where no column is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for b in batches:
            texts = b.column(0).to_pylist()
            asked = [i for i, t in enumerate(texts) if t and not t.isascii() and m.in_question(t)]
            ids = b.column(1).take(pa.array(asked, pa.int64())) if id_col else pa.array([_digest(texts[i]) for i in asked], pa.binary())
            yield pa.record_batch([ids, pa.array([texts[i] for i in asked], pa.string())], ["_id", "text"])

    kind = documents.schema[id_col].dataType.simpleString() if id_col else "binary"
    columns = [F.col(text_col).cast("string"), *([F.col(id_col).alias("_id")] if id_col else [])]
    return documents.select(*columns).mapInArrow(run, f"_id {kind}, text string")


def _counted(texts: DataFrame, chosen) -> DataFrame:
    """``word, n, f0, f1 ...``: how often a word occurs in the texts, and how often in the ``chosen`` ones of each fold."""
    folds = [F.count_if(F.col("chosen") & (F.col("fold") == i)).alias(f"f{i}") for i in range(FOLDS)]
    return texts.select(F.explode("words").alias("word"), "fold", chosen.alias("chosen")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *folds)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tally`` of words with their counts: ``feature``, ``INSIDE`` for pairs of ``ALPHABET``, ``OUTSIDE`` for others; the empty pair has the number of all pairs."""
    counts = np.zeros((len(NAMES) + FOLDS, DIMENSIONS), np.int64)
    pairs: Counter = Counter()

    def told() -> pa.RecordBatch:
        sides = [INSIDE if ALPHABET.issuperset(p) else OUTSIDE for p in pairs]
        got = pa.record_batch([pa.array(sides, pa.int32()), pa.array([*pairs], pa.string()), pa.array([*pairs.values()], pa.int64())], ["feature", "pair", "n"])
        pairs.clear()
        return got

    for b in batches:
        words, ns = (b.column(i).to_pylist() for i in range(2))
        fitted = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(FOLDS)], 1)
        start = size = 0
        for i, w in enumerate(words, 1):
            size += len(w)
            if size < 200_000 and i < len(words):  # so long words do not meet in memory after every chain
                continue
            part, more = tally(words[start:i], ns[start:i], fitted[start:i])
            counts += part
            pairs.update(more)
            pairs[""] += sum(more.values())
            start, size = i, 0
            if len(pairs) > 500_000:
                yield told()
    yield told()
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        yield pa.record_batch([pa.array(part, pa.int32()), pa.nulls(len(part), pa.string()), pa.array(flat[part], pa.int64())], ["feature", "pair", "n"])


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    kept = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in kept]).filter("n > 0")


def _less(rows: DataFrame, gone: DataFrame, *by: str) -> DataFrame:
    """The counts without those of ``gone``."""
    return _sums(rows.unionByName(gone.select(*by, *[(-F.col(c)).alias(c) for c in gone.columns if c not in by])), *by)


def _model(tallied: DataFrame) -> Model:
    """The model of the tallies; what comes to the driver is bounded by DIMENSIONS, chains and ``ALPHABET``."""
    counts = np.zeros((len(NAMES) + FOLDS) * DIMENSIONS, np.int64)
    got = tallied.filter("feature >= 0").select("feature", "n").toArrow()
    counts[got["feature"].to_numpy()] = got["n"].to_numpy()
    inside = tallied.filter(F.col("feature") == INSIDE).select("pair", "n").toArrow()
    pairs = dict(zip(inside["pair"].to_pylist(), inside["n"].to_pylist()))
    total = pairs.pop("", 0)
    model = Model()
    model.learn(counts.reshape(-1, DIMENSIONS), pairs, total)
    return model


def _keyed(words: DataFrame, tallied: DataFrame) -> DataFrame:
    """``key, n`` of words and of pairs beyond ``ALPHABET``, as ``word_key`` and ``pair_key`` name them."""
    key = F.when(F.length("word") <= 64, F.col("word")).otherwise(F.md5("word"))
    return words.select(key.alias("key"), "n").unionByName(tallied.filter(F.col("feature") == OUTSIDE).select(F.concat(F.lit(" "), "pair").alias("key"), "n"))


def fit(documents: DataFrame, text_col: str = "text", sample: int | None = None) -> tuple[Model, DataFrame]:
    """The model and, by key, the counts of words and pairs that are joined to the texts it judges.

    All distinct texts are counted, whole; copies count once, so no text that was delivered a million
    times decides. There are two rounds: what the first finds garbled leaves all counts of the second. With
    ``sample`` the classifier's own features come from about so many texts, chosen by a hash; all other counts do not.
    """
    spark = documents.sparkSession
    texts = materialize(_texts(documents, text_col).dropDuplicates(["digest"]), "texts")
    chosen = F.lit(True) if sample is None else F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, texts.count())))
    words = materialize(_counted(texts, chosen), "words")
    schema = "feature int, pair string, n bigint"
    tallied = materialize(_sums(words.mapInArrow(_tallies, schema), "feature", "pair"), "tallied")
    shared = spark.sparkContext.broadcast(pickle.dumps(_model(tallied)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (1, 3, 4)))
            found = [i for i, (text, keys, ns) in enumerate(rows) if m.garbled(text, dict(zip(keys or [], ns or [])))]
            yield pa.record_batch([b.column(0).take(pa.array(found, pa.int64()))], ["digest"])

    asked = materialize(_asked(documents, None, text_col, shared).dropDuplicates(["_id"]).withColumn("chains", F.lit(None).cast("array<string>")), "asked")
    garbled = _with_counts(asked, _keyed(words, tallied)).mapInArrow(judged, "digest binary")
    gone = materialize(_counted(texts.join(garbled, "digest", "left_semi"), chosen), "gone")
    left = materialize(_less(words, gone, "word"), "words")
    rest = materialize(_less(tallied, _sums(gone.mapInArrow(_tallies, schema), "feature", "pair"), "feature", "pair"), "tallied")
    for done in (texts, asked, words, tallied, gone):
        discard(done)
    return _model(rest), _keyed(left, rest)


def predicted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """The classifier's word alone: ``<id_col>, chain, restored`` of every text whose best stretch is likelier after a chain and decodes strictly.

    Cases are those of ``find``. Byte bigrams cannot tell a rare right word from a garbled one, so some
    clean texts are among these; ``find`` lets words and bigrams counted over all texts decide on them.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(fit(documents, text_col, sample)[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for b in batches:
            got = [(i, p) for i, t in enumerate(b.column(1).to_pylist()) if t and not t.isascii() and (p := m.predict(t))]
            yield pa.record_batch([b.column(0).take(pa.array([i for i, _ in got], pa.int64())), *[pa.array([p[x] for _, p in got], pa.string()) for x in (0, 1)]], [id_col, "chain", "restored"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, chain string, restored string")


def _keys(word: str) -> set[str]:
    """The keys whose counts judge a word: its own, those of its originals under one-byte chains, those of the pairs beyond ``ALPHABET`` in it and in its originals under the others."""
    keys = {word_key(x) for x in (word, *(invert(word, CHAINS[f"{a}>{b}"]) for a, b in _SINGLE)) if x}
    reads: dict[str, str] = {}
    for steps in CHAINS.values():
        if steps[0][0] == "utf-8":
            last = steps[-1][1]
            if last not in reads:
                reads[last] = _undo_utf8(word, last)
            if reads[last] != word and (back := invert(word, steps)) and not ALPHABET.issuperset(back):
                keys.update(pair_key(p) for p in _odd_pairs(back) if not ALPHABET.issuperset(p))
    if not ALPHABET.issuperset(word):
        keys.update(pair_key(p) for p in _odd_pairs(word) if not ALPHABET.issuperset(p))
    return keys


def _originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the keys whose counts judge them."""
    for b in batches:
        out = [(w, k) for w in b.column(0).to_pylist() for k in _keys(w)]
        yield pa.record_batch([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["word", "key"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(r, w) for r, t in zip(*(b.column(i).to_pylist() for i in (0, 1))) for w in set(odd_word_list(t))]
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["_row", "word"])


def _with_counts(waiting: DataFrame, counted: DataFrame) -> DataFrame:
    """``_id, text, chains, keys, ns``: the texts with the counts that judge their words."""
    waiting = waiting.withColumn("_row", F.xxhash64("text"))  # equal texts have equal words; a clash of two others only adds counts to both
    words = waiting.select("_row", "text").mapInArrow(_words, "_row bigint, word string").distinct()
    known = words.select("word").distinct().mapInArrow(_originals, "word string, key string").join(counted, "key")
    known = known.groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("known"))
    per = words.join(known, "word").groupBy("_row").agg(F.flatten(F.collect_list("known")).alias("known"))
    return waiting.join(per.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left").select("_id", "text", "chains", F.col("known.key").alias("keys"), F.col("known.n").alias("ns"))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """The garbled texts: ``<id_col>, chain, restored, complete``.

    Every text is judged as a whole, by a classifier, words and character bigrams counted over all clean
    texts (``fit``). Copies of a text are each reported, and count once where words are counted. Texts for
    which a one-byte chain comes into question wait for the counts of their words, which are joined to
    them; what was restored is judged again in the next round. Characters that were lost (U+FFFD) stay,
    the rest of such a text is restored around them, and ``complete`` is false.

    Defined cases: null, empty and plain ASCII texts are clean; characters that are right as they
    stand are clean however unusual; repeated rows are judged alike and each reported; a null id
    passes through; other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    model, counted = fit(documents, text_col, sample)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # a fixed table of DIMENSIONS x chains and folds, about 6 MB
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["_id", "text", "chains", "waits"]
    state = f"_id {kind}, text string, chains array<string>, waits boolean"

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _load(shared)
        for b in batches:
            rows, got = [], []
            for i, (text, chains, keys, ns) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)))):
                more, text, waits = m.restore(text, dict(zip(keys or [], ns or [])), False, chains is None)
                if chains or more or waits:
                    rows.append(i)
                    got.append((text, [*(chains or []), *more], waits))
            columns = [pa.array([g[x] for g in got], t) for x, t in enumerate((pa.string(), pa.list_(pa.string()), pa.bool_()))]
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *columns], names)

    waiting = materialize(_asked(documents, id_col, text_col, shared), "asked").withColumn("chains", F.lit(None).cast("array<string>"))
    done: DataFrame | None = None
    # A text waits again only when it was changed, so the rounds end.
    while True:
        now = materialize(_with_counts(waiting, counted).mapInArrow(go_on, state), "judged")
        done = now.filter("NOT waits") if done is None else done.unionByName(now.filter("NOT waits"))
        waiting = now.filter("waits").select("_id", "text", "chains")
        if waiting.isEmpty():
            break
    return done.select(
        F.col("_id").alias(id_col), F.concat_ws(", ", F.array_distinct("chains")).alias("chain"), F.col("text").alias("restored"), (~F.col("text").contains(LOST)).alias("complete")
    )


_loaded: dict[int, Model] = {}


def _load(shared) -> Model:
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(shared.value)
    return _loaded[key]
