"""Mixing sources to target weights, in tokens of a public tokenizer.

The tokens of each source are packed end to end into blocks of a fixed length. Block quotas follow
from the weights; the counts of every output shard are multinomial draws of each source's quota
over the shards, so shards are random samples while the totals stay exact. The slots of a source
are mapped to its blocks by a pseudorandom permutation of the block numbers, a new one for each
repetition, and blocks join slots by (source, number). No block is used more often than its source
may be repeated, so no text is. A block names the texts it is made of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import DEFAULT_RANKS, encode_batch, send, tokenizer


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` for every key, element by element.

    A balanced Feistel network over the least even number of bits that holds ``n``; values that
    fall outside are sent through again until they are inside, which keeps it a permutation.
    """
    bits = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 0.5)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out = np.full(len(i), 0, np.uint64)
    todo = np.arange(len(i))
    x = i.astype(np.uint64)
    size, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        b, m = bits[todo], low[todo]
        left, right = x >> b, x & m
        for r in range(rounds):
            h = (right ^ key[todo]) + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & m)
        x = (left << b) | right
        inside = x < size[todo]
        out[todo[inside]] = x[inside]
        todo, x = todo[~inside], x[~inside]
    return out.astype(np.int64)


@dataclass(frozen=True)
class SourcePlan:
    source: str
    weight: float
    max_repeats: int
    tokens: int
    blocks: int
    quota: int  # blocks to draw


def plan_quotas(weights: dict[str, tuple[float, int]], tokens: dict[str, int], block: int, total: int | None = None) -> list[SourcePlan]:
    """Quotas in blocks. The total is as large as the weights and repetition caps allow, or ``total`` tokens if less.

    A source without tokens cannot contribute: its weight goes to the others in proportion.
    """
    able = {s: w for s, (w, r) in weights.items() if w > 0 and r > 0 and tokens.get(s, 0) > 0}
    share = {s: w / sum(able.values()) for s, w in able.items()}
    size = min((weights[s][1] * tokens[s] / w for s, w in share.items()), default=0.0)
    if total is not None:
        size = min(size, float(total))
    exact = {s: share[s] * size / block for s in share}
    quota = {s: int(x) for s, x in exact.items()}
    cap = {s: weights[s][1] * -(-tokens[s] // block) for s in share}
    left = int(round(size / block)) - sum(quota.values())
    for s in sorted(exact, key=lambda s: (quota[s] - exact[s], s)):
        if left > 0 and quota[s] < cap[s]:
            quota[s], left = quota[s] + 1, left - 1
    return [
        SourcePlan(s, w, r, tokens.get(s, 0), -(-tokens.get(s, 0) // block), quota.get(s, 0)) for s, (w, r) in sorted(weights.items())
    ]


def clean_source(c: str) -> F.Column:
    """A source's name in lower case without outer blanks; blank is null."""
    return F.nullif(F.lower(F.btrim(F.col(c))), F.lit(""))


LANES = 1 << 14
SEEN = 200_000  # rows a task remembers, to drop repetitions before anything moves
SHARD_BLOCKS = 4096  # blocks a shard holds, about
GROUP = 1024  # shards whose counts are drawn together


class Mixture:
    """A mixture of ``documents`` (``doc_id, source, text``) by ``targets`` (``source, weight, max_repeats``).

    The result depends on the data, the targets, ``block``, ``lanes``, ``shard_blocks`` and ``seed`` only, never on
    the cluster's settings. With ``separator`` that id follows every text and counts as its last token.

    Defined cases: sources are compared without outer blanks and letter case; texts of no source or
    of one that has no target stay out; null and empty texts have no tokens and no separator; repeated rows of one
    doc_id count once (if they differ, the first by source, number of tokens and tokens), rows without one each;
    targets without a source, weight or cap, or with a weight of 0, get no share (of repeated targets the greatest
    weight counts); the last block of a source is as short as its tokens leave it. Empty tables give an empty mixture.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, block: int = 256, seed: int = 1, total: int | None = None, separator: int | None = None, lanes: int = LANES,
        shard_blocks: int = SHARD_BLOCKS, ranks: str = DEFAULT_RANKS,
    ):
        self.spark = documents.sparkSession
        send(self.spark, ranks)
        self.block, self.seed = block, seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tokenizer(ranks)
            seen: set[tuple] = set()
            for b in batches:
                fresh = []
                for i, (doc, source, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                    key = (doc, source, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    if doc is not None and key in seen:
                        continue
                    fresh.append(i)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                b = b.take(pa.array(fresh, pa.int64()))
                yield pa.record_batch([b.column(0), b.column(1), encode_batch(t, b.column(2))], ["doc_id", "source", "ids"])

        # The targets: one row a source, as many as a configuration names.
        wanted = {
            r["source"]: (float(r["t"]["weight"]), int(r["t"]["max_repeats"]))
            for r in targets.select(clean_source("source").alias("source"), F.struct("weight", "max_repeats").alias("t"))
            .filter("source IS NOT NULL AND t.weight IS NOT NULL AND t.max_repeats IS NOT NULL")
            .groupBy("source").agg(F.max("t").alias("t")).collect()
        }
        named = F.col("source").isin(list(wanted)) if wanted else F.lit(False)
        rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean_source("source").alias("source"), F.col("text").cast("string").alias("text"))
        ids = rows.filter(named & (F.length("text") > 0)).mapInArrow(run, "doc_id bigint, source string, ids array<int>")
        if separator is not None:
            ids = ids.withColumn("ids", F.concat("ids", F.array(F.lit(separator))))
        # Texts are packed lane by lane: a lane is a hash class of ids, so a large source fills all lanes. Rows without an id go by their tokens.
        lane = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.xxhash64("ids")), F.lit(lanes)).cast("int")
        laid = ids.withColumn("lane", lane).withColumn("n", F.size("ids").cast("bigint"))
        same = Window.partitionBy("lane").orderBy("doc_id", "source", "n", F.xxhash64("ids"))
        again = F.coalesce(F.lag("doc_id").over(same) == F.col("doc_id"), F.lit(False))
        order = Window.partitionBy("lane", "source").orderBy("doc_id", "n", F.xxhash64("ids"))
        once = laid.withColumn("again", again).filter(~F.col("again")).drop("again")
        self.packed = materialize(once.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))), "packed")
        per_lane = self.packed.groupBy("source", "lane").agg(F.sum("n").alias("tokens"))
        before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.lane_starts = per_lane.select(F.col("source").alias("_s"), F.col("lane").alias("_l"), before.alias("start"))  # LANES rows a source
        tokens = {r[0]: r[1] for r in per_lane.groupBy("source").agg(F.sum("tokens")).collect()}  # one row a target source
        self.plan = plan_quotas(wanted, tokens, block, total)
        self.shards = max(1, -(-sum(p.quota for p in self.plan) // shard_blocks))

    def pieces(self, with_ids: bool) -> DataFrame:
        """The stretches of texts in blocks: ``source, block, off, n, doc_id, start`` and the ids on demand.

        ``start`` is where in its text a stretch begins; ``off`` its place among the tokens of the source.
        """
        starts = self.lane_starts
        d = self.packed.join(starts, (F.col("source") == F.col("_s")) & (F.col("lane") == F.col("_l")))
        first = (F.col("start") + F.col("upto") - F.col("n")).alias("first")
        b = F.lit(self.block).cast("bigint")
        d = d.select("source", "doc_id", first, "n", *(["ids"] if with_ids else [])).filter("n > 0")
        last = F.col("first") + F.col("n") - 1
        d = d.select("*", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor(last / b))).alias("block"))
        low = F.greatest(F.col("first"), F.col("block") * b)
        size = (F.least(last + 1, (F.col("block") + 1) * b) - low).cast("int")
        at = low - F.col("first")
        cut = F.slice("ids", (at + 1).cast("int"), size).alias("ids")
        return d.select("source", "block", low.alias("off"), size.alias("n"), "doc_id", at.alias("start"), *([cut] if with_ids else []))

    def blocks(self) -> DataFrame:
        """The packed blocks: ``source, block, ids, docs``; ``docs`` has ``doc_id, start, n`` of the stretches, in order."""
        parts = self.pieces(True).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("off", "n", "doc_id", "start", "ids"))).alias("p"))
        docs = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["n"].alias("n")))
        return parts.select("source", "block", F.flatten(F.col("p.ids")).alias("ids"), docs.alias("docs"))

    def slots(self) -> DataFrame:
        """The drawn slots: ``shard, source, epoch, block, draw``; ``draw`` is a pseudorandom place within the shard.

        A source's quota is drawn over groups of shards here, a number a group, and over the shards of a group in its
        task; both are multinomial, so the whole is. A row then stands for the slots of one shard, whose number is bounded.
        """
        rng = np.random.default_rng(self.seed)
        sizes = [min(GROUP, self.shards - g) for g in range(0, self.shards, GROUP)]
        rows = []
        for k, p in enumerate(self.plan):
            if p.quota:
                counts = rng.multinomial(p.quota, np.array(sizes) / self.shards)
                starts = np.cumsum(counts) - counts
                rows += [(g, n, p.source, k, p.blocks, int(a), int(c)) for g, (n, a, c) in enumerate(zip(sizes, starts, counts)) if c]
        table = self.spark.createDataFrame(rows, "part int, shards int, source string, k int, blocks bigint, first bigint, count bigint").repartition("part", "k")
        seed = self.seed

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    counts = np.random.default_rng([seed, r["k"], r["part"]]).multinomial(r["count"], np.full(r["shards"], 1 / r["shards"]))
                    some = np.flatnonzero(counts)
                    n = len(some)
                    columns = [
                        pa.array(r["part"] * GROUP + some, pa.int64()), pa.array([r["source"]] * n, pa.string()), pa.array([r["k"]] * n, pa.int32()), pa.array([r["blocks"]] * n, pa.int64()),
                        pa.array((r["first"] + np.cumsum(counts) - counts)[some], pa.int64()), pa.array(counts[some], pa.int64()),
                    ]
                    yield pa.record_batch(columns, ["shard", "source", "k", "blocks", "first", "count"])

        shared = table.mapInArrow(share, "shard bigint, source string, k int, blocks bigint, first bigint, count bigint")
        each = shared.select("shard", "source", "k", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, n, slot = (b.column(i).to_numpy() for i in (2, 3, 4))
                epoch = slot // n
                key = (np.uint64(seed) << np.uint64(40)) ^ (k.astype(np.uint64) << np.uint64(20)) ^ epoch.astype(np.uint64)
                block = permute(slot % n, n, key)
                out = [b.column(0), b.column(1), pa.array(epoch.astype(np.int32)), pa.array(block), b.column(4)]
                yield pa.record_batch(out, ["shard", "source", "epoch", "block", "slot"])

        drawn = each.mapInArrow(run, "shard bigint, source string, epoch int, block bigint, slot bigint")
        return drawn.select("shard", "source", "epoch", "block", F.xxhash64("source", "slot", F.lit(self.seed)).alias("draw"))

    def mixture(self) -> DataFrame:
        """The mixed blocks: ``shard, draw, source, epoch, block, n_tokens, ids, docs``; within a shard ordered by ``draw``.

        ``docs`` names the stretches of texts a block is made of, so uses of a text can be counted from the result.
        """
        b = self.blocks().withColumnsRenamed({"source": "_s", "block": "_b"})
        joined = self.slots().join(b, (F.col("source") == F.col("_s")) & (F.col("block") == F.col("_b")))
        return joined.select("shard", "draw", "source", "epoch", "block", F.size("ids").alias("n_tokens"), "ids", "docs")

    def _uses(self) -> DataFrame:
        return self.slots().groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count(F.lit(1)).alias("uses"))

    def doc_uses(self) -> DataFrame:
        """How often each text was used: ``doc_id, source, tokens, used_tokens, most_uses, max_repeats``, most_uses that of its most used stretch.

        Texts without an id come as one row a source.
        """
        used = self.pieces(False).join(self._uses(), (F.col("source") == F.col("_s")) & (F.col("block") == F.col("_b")), "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
        caps = F.create_map(*[F.lit(x) for p in self.plan for x in (p.source, p.max_repeats)]) if self.plan else F.lit(None).cast("map<string,int>")
        per = used.groupBy("doc_id", "source").agg(F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
        return per.withColumn("max_repeats", caps[F.col("source")])

    def shares(self) -> DataFrame:
        """What was reached, by source: ``source, weight, max_repeats, available_tokens, blocks, tokens, share, most_uses``."""
        sizes = self.pieces(False).groupBy("source", "block").agg(F.sum("n").alias("n"))
        used = self._uses().join(sizes, (F.col("source") == F.col("_s")) & (F.col("block") == F.col("_b")))
        per = used.groupBy(F.col("source").alias("_src")).agg(
            F.sum("uses").alias("blocks"), F.sum(F.col("n") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
        )
        plan = self.spark.createDataFrame(
            [(p.source, p.weight, p.max_repeats, p.tokens) for p in self.plan], "source string, weight double, max_repeats int, available_tokens bigint"
        )
        got = plan.join(per, F.col("source") == F.col("_src"), "left").drop("_src").fillna(0, ["blocks", "tokens", "most_uses"])
        total = F.sum("tokens").over(Window.partitionBy())  # over one row a source
        return got.select("*", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("share"))
