"""Shares, caps and contents of mixtures."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import bpe
from siltstone.llm.mixing import Mixture, permute, plan_quotas

DOCS = "doc_id bigint, source string, text string, lane string"
TARGETS = "source string, weight double, max_repeats int"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    seen = set()
    for key in range(4):
        p = permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(p) == list(range(n))
        seen.add(tuple(p))
    assert n < 7 or len(seen) == 4


def test_quotas():
    plan = {p.source: p.quota for p in plan_quotas({"a": (0.5, 1), "b": (0.5, 4), "c": (0.0, 1), "gone": (1.0, 1)}, {"a": 1000, "b": 300, "c": 50}, 10)}
    assert plan == {"a": 100, "b": 100, "c": 0, "gone": 0}
    assert sum(p.quota for p in plan_quotas({"a": (1.0, 1)}, {"a": 1000}, 10, total=255)) in (25, 26)
    assert plan_quotas({}, {}, 10) == []


def corpus(spark, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k, source, f"speech {k} of {source} " + "word " * (k % 40), "x"))
    return rows


def test_mixture(spark):
    rows = corpus(spark, {"big": 600, " Small ": 60, "mid": 200, "other": 50}) + [(9001, None, "stray", "x"), (9002, "big", None, "x"), (9003, "big", "", "x")]
    rows += rows[:50]  # repeated rows count once
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.2, 3), ("mid", 0.3, 1), ("empty", 0.1, 1), (None, 0.1, 1)], TARGETS)
    m = Mixture(docs, targets, block=32, shard_blocks=40)
    out = m.mixture().collect()
    t = bpe.tokenizer()
    per_source = defaultdict(list)
    for i, s, x, _ in sorted(set(r for r in rows if r[1] and r[2]), key=lambda r: r[0]):
        per_source[s.strip().lower()].append(t.encode(x))
    blocks = {(r.source, r.block): r.ids for r in m.blocks().collect()}
    for s in ("big", "small", "mid"):
        packed = [i for (q, _), b in sorted(blocks.items()) if q == s for i in b]
        assert Counter(packed) == Counter(i for d in per_source[s] for i in d)  # every token in one block
        assert all(len(b) == 32 for (q, k), b in blocks.items() if q == s and (q, k + 1) in blocks)
    uses = Counter((r.source, r.block) for r in out)
    assert all(n <= {"big": 1, "small": 3, "mid": 1}[s] for (s, _), n in uses.items())
    assert all(r.ids == blocks[r.source, r.block] and r.n_tokens == len(r.ids) for r in out)
    total = sum(r.n_tokens for r in out)
    want = {"big": 0.5, "small": 0.2, "mid": 0.3}
    norm = sum(want.values())
    for s, w in want.items():
        assert abs(sum(r.n_tokens for r in out if r.source == s) / total - w / norm) < 0.02
    shares = {r.source: r for r in m.shares().collect()}
    assert {s: shares[s].tokens for s in want} == {s: sum(r.n_tokens for r in out if r.source == s) for s in want}
    assert shares["empty"].tokens == 0 and sum(r.share for r in shares.values()) == pytest.approx(1.0)
    assert len({r.shard for r in out}) == m.shards > 3
    # The texts of a block, and their uses counted from the result, stretch by stretch.
    text_ids = {k: t.encode(x) for k, _, x, _ in rows if x}
    used = Counter()
    for r in out:
        assert r.ids == [i for d in r.docs for i in text_ids[d.doc_id][d.start : d.start + d.n]]
        for d in r.docs:
            used.update((d.doc_id, at) for at in range(d.start, d.start + d.n))
    caps = {k: {"big": 1, "small": 3, "mid": 1}.get((s or "").strip().lower()) for k, s, _, _ in rows}
    assert used and all(n <= caps[k] for (k, _), n in used.items())
    per = {r.doc_id: r for r in m.doc_uses().collect()}
    assert all(r.tokens == len(text_ids[k]) and r.most_uses <= r.max_repeats == caps[k] for k, r in per.items())
    assert {k: r.used_tokens for k, r in per.items() if r.used_tokens} == {k: n for k in per if (n := sum(used[k, a] for a in range(len(text_ids[k]))))}
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # the cluster's settings change nothing
    again = Mixture(docs.repartition(5), targets, block=32, shard_blocks=40).mixture().collect()
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_separator_and_repetitions(spark):
    t = bpe.tokenizer()
    rows = [(1, "a", "one two", "x"), (2, "a", "three", "x"), (None, "a", "four", "x"), (None, "a", "four", "x"), (5, "a", "", "x")] + [(1, "a", "one two", "x")] * 300 + [(2, "b", "three", "x")]
    m = Mixture(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS), block=1000, separator=50256)
    (b,) = m.blocks().collect()  # the copy of 2 under another source counts once, under the first
    assert Counter(b.ids) == Counter([i for x in ("one two", "three", "four", "four") for i in (*t.encode(x), 50256)])
    at = 0
    for d in b.docs:
        assert b.ids[at + d.n - 1] == 50256 and d.start == 0
        at += d.n


def test_groups_of_shards(spark, monkeypatch):
    from siltstone.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 4)
    m = Mixture(spark.createDataFrame(corpus(spark, {"a": 300, "b": 300}), DOCS), spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS), block=16, shard_blocks=20)
    slots = m.slots().collect()
    assert m.shards > 12 and len({r.shard for r in slots}) == m.shards
    assert Counter(r.source for r in slots) == {p.source: p.quota for p in m.plan}
    assert max(Counter((r.source, r.block) for r in slots).values()) <= 2


def test_empty(spark):
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    assert Mixture(*none).mixture().count() == 0 and Mixture(*none).shares().count() == 0
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert [r.tokens for r in Mixture(none[0], targets).shares().collect()] == [0]
