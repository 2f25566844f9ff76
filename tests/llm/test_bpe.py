"""The transducer against the public library, streaming in any portions, and exact round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def t():
    try:
        return bpe.tokenizer()
    except OSError:
        pytest.skip("no vocabulary here")


@pytest.fixture(scope="module")
def library(t):
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=t.v.ids, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(t, library, text):
    ids = t.encode(text)
    assert ids == library.encode_ordinary(text) and t.decode(ids) == text


@pytest.mark.parametrize("text", ["", None, " ", "\n\n  x", "it's we'll I'M", "<|endoftext|>", "a\u0301", "🏴‍☠️", "١٢٣ 456", "\x00\x7f", "x" * 300, " " * 300, "'" * 50])
def test_cases(t, library, text):
    assert t.encode(text) == library.encode_ordinary(text or "")


@pytest.mark.parametrize("seed", range(60))
def test_streams_of_hard_pieces(t, library, seed):
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab", "aaab", " \t\n", "0123", "ing the ", "étéüß", "!?-='", "abcdefghijklmnopqrstuvwxyz", "日本語"])
    text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9000))) + rnd.choice(["", "'ll", "  x", "\n\n", "l's "]) + "tail 1"
    size = rnd.randint(1, 3000)
    e = bpe.Encoder(t.v, t.pieces)
    packed = b"".join([*(e.feed(text[i : i + size]) for i in range(0, len(text), size)), e.finish()])
    assert np.frombuffer(packed, "<i4").tolist() == library.encode_ordinary(text)


def test_memory_of_a_piece_stays_bounded(t, library):
    p = bpe.PieceTransducer(t.v)
    ids = []
    for _ in range(60):
        ids += p.feed(b"ab" * 700)
        assert len(p.held) <= 2 * p.window
    ids += p.finish()
    assert ids == library.encode_ordinary("ab" * 700 * 60)


def test_every_piece_runs_through_the_transducer(library):
    t = bpe.Tokenizer()
    text = "Ungewöhnliche Zwischenrufe, zażółć gęślą jaźń; it's 12345 xq zzq  \n" * 3 + "y" * 9000
    assert t.encode(text) == library.encode_ordinary(text)
    pieces = set(bpe._PIECE.findall(text))
    no_tokens = {p for p in pieces if p.encode() not in t.v.ids}
    assert len(no_tokens) > 5 and t.pieces.transducer.pieces == len({p for p in no_tokens if len(p) <= 256})
    assert t.encode("") == [] and t.encoder.held == "" and t.encoder.open is None


def test_decoding_bit_by_bit(t):
    text = "naïve 🏴‍☠️ żółć"
    parts = list(t.decode_stream(t.encode(text)))
    assert "".join(parts) == text and "�" not in "".join(parts)


def test_query(spark, t):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "c", "x"), (1, "a b", "x"), (4, "long " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode(docs).collect()))
    assert got == sorted((r[0] or 0, t.encode(r[1])) for r in rows)
    assert bpe.encode(docs.limit(0)).collect() == []
    assert bpe.encode(docs).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_corpus(spark, small, library):
    from siltstone.llm.queries import p6_ids

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in p6_ids(spark, small).collect()}
    assert got == {k: library.encode_ordinary(v or "") for k, v in texts.items()}


def test_the_vocabulary_is_sent_along(spark, t, tmp_path):
    import shutil

    own = tmp_path / "sent_along.tiktoken"
    shutil.copy(bpe.DEFAULT_RANKS, own)
    docs = spark.createDataFrame([(1, "speech one")], "doc_id bigint, text string")
    bpe.send(spark, str(own))
    assert bpe.encode(docs, ranks="/nowhere/sent_along.tiktoken").first().ids == t.encode("speech one")  # as on an executor without that path
