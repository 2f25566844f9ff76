"""Occurrences and document frequency of every distinct term, in a vertical layout.

Every term has a compressed bitmap of the records that hold it, and beside it a counter of its
occurrences. Bitmaps are cut into containers of 2**16 record ids: a sparse container is a sorted
array of 16-bit numbers, a dense one a bit set of 8 KB. Partial containers are built where the rows
lie, so a hot term leaves a partition as one small row per container; they are merged by union and
the document frequency is read from their cardinality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unique_or_row

DENSE = 4096  # ids from which on a container is a bit set
_BITS = 1 << 16
CONTAINERS = "kind string, name string, bucket bigint, ids binary, occurrences bigint"
_CONTAINERS = pa.schema([("kind", pa.string()), ("name", pa.string()), ("bucket", pa.int64()), ("ids", pa.binary()), ("occurrences", pa.int64())])


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a container."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(_BITS, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The sorted numbers of a container."""
    if len(container) < 2 * DENSE:
        return np.frombuffer(container, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype(np.uint16)


def union(containers: list[bytes]) -> bytes:
    """The union of containers."""
    if all(len(c) < 2 * DENSE for c in containers):
        return pack(np.unique(np.frombuffer(b"".join(containers), "<u2")))
    bits = np.zeros(_BITS // 8, np.uint8)
    for c in containers:
        dense = c if len(c) >= 2 * DENSE else None
        if dense is None:
            one = np.zeros(_BITS, np.uint8)
            one[np.frombuffer(c, "<u2")] = 1
            bits |= np.packbits(one, bitorder="little")
        else:
            bits |= np.frombuffer(dense, np.uint8)
    return bits.tobytes()  # a union is no smaller than its dense part


def cardinality(container: bytes) -> int:
    return len(container) // 2 if len(container) < 2 * DENSE else int(np.unpackbits(np.frombuffer(container, np.uint8)).sum())


def _build(rows: int):
    """Containers of up to ``rows`` input rows at once; a null record id counts an occurrence in an empty container."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        kinds, names = (pc.dictionary_encode(t.column(i).combine_chunks()) for i in (0, 1))
        n_names = max(1, len(names.dictionary))
        term = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_names + names.indices.to_numpy(zero_copy_only=False)
        ids = t.column(2).combine_chunks()
        here = ids.is_valid().to_numpy(zero_copy_only=False)
        record = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((record, here, term))
        term, record, here = term[order], record[order], here[order]
        bucket, low = record >> 16, (record & (_BITS - 1)).astype("<u2")
        new = np.r_[True, (term[1:] != term[:-1]) | (bucket[1:] != bucket[:-1]) | (here[1:] != here[:-1])]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(term)]
        fresh = here & (new | np.r_[True, low[1:] != low[:-1]])  # the first row of each record of a term
        upto = np.r_[0, np.cumsum(fresh)]
        sizes = upto[ends] - upto[starts]
        kept = low[fresh]
        if len(sizes) and sizes.max() >= DENSE:
            containers = pa.array([pack(kept[upto[a] : upto[b]]) for a, b in zip(starts, ends)], pa.binary())
        else:
            offsets = np.r_[0, np.cumsum(2 * sizes)].astype(np.int32)
            containers = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
        heads = term[starts]
        columns = [
            kinds.dictionary.take(pa.array(heads // n_names)), names.dictionary.take(pa.array(heads % n_names)),
            pa.array(bucket[starts]), containers, pa.array(ends - starts),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_CONTAINERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the containers of equal (kind, name, bucket) in sorted input; groups may run over batches."""
    carry: pa.Table | None = None

    def merged(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        kind, name, bucket, ids, occ = (t.column(i).combine_chunks() for i in range(5))
        change = np.r_[True, _differs(kind) | _differs(name) | _differs(bucket)]
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], len(change)]
        sums = np.add.reduceat(occ.to_numpy(), starts)
        out = ids.take(pa.array(starts))
        many = np.flatnonzero(ends - starts > 1)
        if len(many):
            values = out.to_pylist()
            for g in many:
                values[g] = union(ids.slice(starts[g], ends[g] - starts[g]).to_pylist())
            out = pa.array(values, pa.binary())
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([kind.take(at), name.take(at), bucket.take(at), out, pa.array(sums)], schema=_CONTAINERS)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b.cast(_CONTAINERS)])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        last = t.num_rows - 1
        start = last
        key = [t.column(i)[last] for i in range(3)]
        while start and all(t.column(i)[start - 1] == key[i] for i in range(3)):
            start -= 1
        if start:
            yield merged(t.slice(0, start))
        carry = t.slice(start)
        if carry.num_rows > 64:  # what is carried stays small however long a group is
            carry = pa.Table.from_batches([merged(carry)])
    if carry is not None:
        yield merged(carry)


def _differs(a: pa.Array) -> np.ndarray:
    return pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)


def term_bitmaps(rows: DataFrame, chunk: int = 500_000) -> DataFrame:
    """One row per (kind, name) and 2**16 record ids: ``kind, name, bucket, ids, occurrences``.

    ``rows`` has ``id, record, kind, name``, kind and name clean. Rows of one id count once (the
    smallest if they differ), rows without an id each; a null kind or name is left out.
    """
    here = rows.filter(F.col("kind").isNotNull() & F.col("name").isNotNull())
    once = (
        here.select(unique_or_row(F.col("id")).alias("_u"), F.struct("kind", "name", F.col("record").cast("bigint").alias("record")).alias("r"))
        .groupBy("_u").agg(F.min("r").alias("r")).select("r.kind", "r.name", "r.record")
    )
    parts = once.mapInArrow(_build(chunk), CONTAINERS)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # By bucket too, so that the containers of a hot term spread over all tasks.
    keys = ("kind", "name", "bucket")
    return parts.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_merge, CONTAINERS)


HELD_BUCKETS = 1024  # bit sets of 8 KB a task holds while it adds up


def remaining_records(bitmaps: DataFrame) -> DataFrame:
    """How many distinct records hold any term: the cardinality of the union of all bitmaps, one row ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            sets = [pack(np.flatnonzero(v).astype(np.uint16)) for v in held.values()]
            out = pa.record_batch([pa.array([*held], pa.int64()), pa.array(sets, pa.binary())], ["bucket", "ids"])
            held.clear()
            return out

        for b in batches:
            for bucket, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket not in held:
                    if len(held) >= HELD_BUCKETS // 8:  # a byte a record while adding up
                        yield flush()
                    held[bucket] = np.zeros(_BITS, np.uint8)
                held[bucket][unpack(ids)] = 1
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted input: one bucket is held at a time."""
        at, held, n = None, np.zeros(_BITS, np.uint8), 0
        for b in batches:
            for bucket, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != at:
                    n += int(held.sum())
                    held[:] = 0
                    at = bucket
                held[unpack(ids)] = 1
        yield pa.record_batch([pa.array([n + int(held.sum())], pa.int64())], ["n"])

    shape = "bucket bigint, ids binary"
    parts = bitmaps.select("bucket", "ids").filter(F.length("ids") > 0).mapInArrow(run, shape)
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def term_frequencies(bitmaps: DataFrame) -> DataFrame:
    """``kind, name, occurrences, n_files`` from the bitmaps: the frequency is the cardinality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            n = pc.divide(pc.binary_length(ids).cast(pa.int64()), 2).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(n >= DENSE):
                n[i] = cardinality(ids[int(i)].as_py())
            yield pa.record_batch([b.column(0), b.column(1), b.column(4), pa.array(n)], ["kind", "name", "occurrences", "n_files"])

    each = bitmaps.mapInArrow(run, "kind string, name string, occurrences bigint, n_files bigint")
    return each.groupBy("kind", "name").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_files").alias("n_files"))


def marked(frequencies: DataFrame, n_records: int | Column, common_share: float = 0.05) -> DataFrame:
    """The frequencies with ``mark``: rare for one record, else common from ``common_share`` of the records on, else null.

    ``n_records`` is a number or a column, as ``remaining_records(...).scalar()`` is.
    """
    n = n_records if isinstance(n_records, Column) else F.lit(n_records)
    mark = F.when(F.col("n_files") == 1, F.lit("rare")).when(F.col("n_files") >= F.lit(common_share) * n, F.lit("common"))
    return frequencies.withColumn("mark", mark)
