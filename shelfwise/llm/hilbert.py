"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2 ** BITS`` cells, the cells' coordinates are turned
into a position on the Hilbert curve, rows are sorted by it, and the sorted run is cut
into shards of equal row counts (the ``rows`` law: counts differ by one at most). Rows
that are near in all dimensions lie in the same shard, so files carry tight minima and
maxima of every dimension and readers can skip them.

Dimensions of documents: language and source (rank of the value's hash, so cells do not
depend on how frequent a value is), text bytes (logarithmic) and doc_id (equal-width
between the table's bounds). A null takes cell 0 of its dimension.

The global order never meets in one task: rows, reduced to their metadata, are
range-partitioned by the curve position (ties: doc_id, text hash, then a spread number,
so even a cell with a third of all rows spans many ranges), sorted within their range,
numbered there, and shifted by the range offsets (one number per range).

Defined cases: null, empty and very long texts (size 8 for null and empty; crc32 of no
bytes, 0); repeated rows are rows of their own; ties keep doc_id order; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialize

BITS = 6
SHARDS = 24
SIZE_OVERHEAD = 8


def hilbert_positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of the rows of ``cells`` (n x dimensions, each below ``2 ** bits``).

    Undo excess work from the top bit down, Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= np.where(high, 0, swap)
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    position = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            position = (position << 1) | ((x[i] >> b) & 1)
    return position


def _bucket(column: str, cells: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.col(column)), F.lit(cells - 1)) + 1, F.lit(0))


def _metadata(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, size, text_crc32 and the quantised dimensions d0..d3; the text itself goes no further."""
    cells = 1 << bits
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    low, high = docs.agg(F.min("doc_id").cast("bigint"), F.max("doc_id").cast("bigint")).first()
    width = max(1, (high or 0) - (low or 0) + 1)
    # in double: the distance of two ids may not fit a long
    id_cell = F.least(F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) * (float(cells - 1) / width)), F.lit(cells - 2)) + 1
    size_cell = F.least(F.floor(F.log2(F.octet_length(raw) + 1) * (cells / 40.0)), F.lit(cells - 1))
    null_lang, null_source = F.col("lang").isNull(), F.col("source").isNull()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(raw) + SIZE_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(null_lang, 0).otherwise(_bucket("lang", cells)).cast("int").alias("d0"),
        F.when(null_source, 0).otherwise(_bucket("source", cells)).cast("int").alias("d1"),
        size_cell.cast("int").alias("d2"),
        F.coalesce(id_cell, F.lit(0)).cast("int").alias("d3"),
        F.monotonically_increasing_id().alias("spread"),
    )


POSITION_SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, spread bigint, curve bigint"
NUMBERED_SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, curve bigint, part int, place bigint"


def _with_curve(meta: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.column_stack([batch.column(f"d{i}").to_numpy(zero_copy_only=False) for i in range(4)])
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "size", "text_crc32", "spread")]
                                  + [pa.array(hilbert_positions(cells, bits), pa.int64())],
                                  names=["doc_id", "size", "text_crc32", "spread", "curve"])

    return meta.mapInArrow(run, POSITION_SCHEMA)


def _numbered(ordered: DataFrame) -> DataFrame:
    """Number the sorted rows of each range from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "size", "text_crc32", "curve")]
                                  + [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(place, place + n), pa.int64())],
                                  names=["doc_id", "size", "text_crc32", "curve", "part", "place"])
            place += n

    return ordered.mapInArrow(run, NUMBERED_SCHEMA)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Every row's shard (0 to ``shards - 1``) and its slot there, gapless from 0 in curve order.

    Columns: doc_id, size (text bytes plus 8), text_crc32, law, shard, slot, grown_shard
    (null: the law is not ``key``), curve (position on the curve).
    """
    order = ["curve", "doc_id", "text_crc32", "spread"]
    ranged = _with_curve(_metadata(docs, bits), bits).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(_numbered(ranged), "hilbert")
    # one row per range: its number of rows and the rows before it
    ranges = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    position = F.col("before") + F.col("place")
    shard = F.expr(f"CAST(position * {shards} DIV total AS INT)")
    first = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return (numbered.join(F.broadcast(ranges), "part")
            .withColumn("position", position).withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("position") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"))
