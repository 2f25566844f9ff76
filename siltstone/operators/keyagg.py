"""Per-key totals under heavy skew, with dense accumulator arrays.

A few names hold most rows, so no step here groups raw rows by name:

1. Rows are made unique by their id (a uniform key) and counted per (name, file, target), over
   which the hot names spread; distinct (name, file) and (name, target) follow from that.
2. The result is cut into splits by the hash of these keys, so splits are equal however skewed
   the names are. Each split dictionary-encodes its names and scatters the measures into dense
   arrays with ``numpy.bincount``.
3. The arrays leave a split as blocks, one row per (split, block); a block holds the names whose
   hash falls into it. Blocks are summed by a two-level distributed reduction: first within
   groups of splits, then over the groups, so no task ever receives more than about the square
   root of the splits times one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, unique_or_row

MEASURES = ("n_rows", "n_files", "n_resolved", "n_targets")
_BLOCK_SCHEMA = "side string, block int, lane int, names array<string>, " + ", ".join(
    f"{m} array<bigint>" for m in MEASURES
)
_BLOCK_ARROW = pa.schema(
    [("side", pa.string()), ("block", pa.int32()), ("lane", pa.int32()), ("names", pa.list_(pa.string()))]
    + [(m, pa.list_(pa.int64())) for m in MEASURES]
)


def _blocks_of(names: pa.Array, sides: pa.Array, blocks: np.ndarray, values: list[np.ndarray], lane: int) -> pa.RecordBatch:
    """Sum ``values`` per (side, name) densely and lay the sums out as one row per (side, block)."""
    side_dict = pc.dictionary_encode(sides)
    name_dict = pc.dictionary_encode(names)
    n_names = max(1, len(name_dict.dictionary))
    code = side_dict.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_names + name_dict.indices.to_numpy(
        zero_copy_only=False
    )
    size = n_names * max(1, len(side_dict.dictionary))
    sums = []
    for v in values:
        acc = np.zeros(size, np.int64)
        np.add.at(acc, code, v)
        sums.append(acc)
    used = np.bincount(code, minlength=size).nonzero()[0]
    block_of = np.zeros(size, np.int32)
    block_of[code] = blocks
    order = used[np.lexsort((block_of[used], used // n_names))]
    key = (order // n_names) * (int(block_of.max(initial=0)) + 1) + block_of[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(order) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(order)].astype(np.int32))
    heads = order[starts]
    lists = [pa.ListArray.from_arrays(offsets, name_dict.dictionary.take(pa.array(order % n_names)))]
    lists += [pa.ListArray.from_arrays(offsets, pa.array(s[order])) for s in sums]
    columns = [
        side_dict.dictionary.take(pa.array(heads // n_names)),
        pa.array(block_of[heads]),
        pa.array(np.full(len(heads), lane, np.int32)),
        *lists,
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _BLOCK_ARROW)], schema=_BLOCK_ARROW)


def _accumulate(n_blocks: int, lanes: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % lanes
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda n: t.column(n).combine_chunks()
            return _blocks_of(
                col("name"),
                col("side"),
                col("block").to_numpy(zero_copy_only=False),
                [col(m).to_numpy(zero_copy_only=False) for m in MEASURES],
                lane,
            )

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _reduce(lane_to: int):
    def run(group: pa.Table) -> pa.Table:
        flat = lambda n: pc.list_flatten(group.column(n)).combine_chunks()
        sizes = pc.list_value_length(group.column("names")).to_numpy()
        sides = group.column("side").combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        blocks = np.repeat(group.column("block").to_numpy(), sizes)
        lane = int(group.column("lane")[0].as_py()) if lane_to < 0 else lane_to
        out = _blocks_of(flat("names"), sides, blocks, [flat(m).to_numpy(zero_copy_only=False) for m in MEASURES], lane)
        return pa.Table.from_batches([out])

    return run


def key_totals(rows: DataFrame, block_names: int = 20_000, chunk: int = 1_000_000) -> DataFrame:
    """Complete totals for every key of every side.

    ``rows`` has the columns ``side, id, name, file_id, target`` (any others are ignored, whatever
    their names). Returns ``side, name, n_rows, n_files, n_resolved, n_targets``: records, distinct
    non-null files, records with a target, and distinct targets of each name.

    Defined cases: a null name is left out, an empty name counts as a name; repeated rows of one id
    count once (if they differ, the smallest by name, file and target); rows without an id count
    each; a null file counts as a record but as no file; an empty input gives an empty result.
    A block holds about ``block_names`` names.
    """
    cleaned = rows.select(
        "side",
        unique_or_row(F.col("id")).alias("_u"),
        clean_name("name").alias("name"),
        F.col("file_id").cast("bigint").alias("file_id"),
        F.col("target").cast("string").alias("target"),
    ).filter(F.col("name").isNotNull())
    unique = (
        cleaned.groupBy("side", "_u").agg(F.min(F.struct("name", "file_id", "target")).alias("r")).select("side", "r.*")
    )
    each = unique.groupBy("side", "name", "file_id", "target").agg(F.count(F.lit(1)).alias("n_rows"))
    # About how many names there are, one number: a block is to hold ``block_names`` of them.
    n_names = cleaned.select(F.approx_count_distinct("name")).first()[0]
    return _reduced(each, max(1, -(-n_names // block_names)), chunk)


def _reduced(each: DataFrame, least_blocks: int, chunk: int) -> DataFrame:
    spark = each.sparkSession
    splits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    lanes = max(1, int(round(splits**0.5)))
    n_blocks = max(splits, least_blocks, 8)
    block = F.pmod(F.xxhash64("name"), F.lit(n_blocks)).cast("int").alias("block")
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")

    def one_of(rows: DataFrame, measure: str) -> DataFrame:
        return rows.select("side", "name", block, *[(one if m == measure else none).alias(m) for m in MEASURES])

    counted = each.select("side", "name", block, "n_rows", none.alias("n_files"), F.when(F.col("target").isNotNull(), F.col("n_rows")).otherwise(none).alias("n_resolved"), none.alias("n_targets"))
    in_files = each.filter(F.col("file_id").isNotNull()).select("side", "name", "file_id").distinct()
    on_targets = each.filter(F.col("target").isNotNull()).select("side", "name", "target").distinct()
    rows = counted.unionByName(one_of(in_files, "n_files")).unionByName(one_of(on_targets, "n_targets"))
    parts = rows.mapInArrow(_accumulate(n_blocks, lanes, chunk), _BLOCK_SCHEMA)
    lane_sums = parts.groupBy("block", "lane").applyInArrow(_reduce(-1), _BLOCK_SCHEMA)
    sums = lane_sums.groupBy("block").applyInArrow(_reduce(0), _BLOCK_SCHEMA)
    return sums.select("side", F.explode(F.arrays_zip("names", *MEASURES)).alias("z")).select(
        "side", F.col("z.names").alias("name"), *[F.col(f"z.{m}").alias(m) for m in MEASURES]
    )


def name_sides(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """The two sides of the project's data in the shape ``key_totals`` takes."""
    nothing = F.lit(None).cast("string")
    left = symbols.select(F.lit("symbol").alias("side"), F.col("symbol_id").alias("id"), "name", "file_id", nothing.alias("target"))
    right = refs.select(
        F.lit("reference").alias("side"), F.col("ref_id").alias("id"), F.col("target_name").alias("name"), "file_id",
        F.col("target_file").alias("target"),
    )
    return left.unionByName(right)


def heavy_keys(totals: DataFrame, share: float = 0.02) -> DataFrame:
    """The keys holding at least ``share`` of their side's rows: ``side, key_name, n_rows, side_rows``.

    ``totals`` is what ``key_totals`` returns, best materialized. The totals of the sides are one
    row per side (two here), so that join side is bounded by the number of sides.
    """
    per_side = totals.groupBy(F.col("side").alias("_side")).agg(F.sum("n_rows").alias("side_rows"))
    joined = totals.join(F.broadcast(per_side), F.col("side") == F.col("_side"))
    return joined.filter(F.col("n_rows") >= F.col("side_rows") * F.lit(share)).select(
        "side", F.col("name").alias("key_name"), "n_rows", "side_rows"
    )
