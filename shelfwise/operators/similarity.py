"""Blocked similarity search (T4, T5): exact top-k by matrix products, and a locality-sensitive index as the option.

Exact form. Vectors are brought to length one and packed into blocks of one dimension; query blocks meet
corpus blocks on a grid of cells whose sides follow the measured numbers of blocks, so the work of a cell is bounded and cells
grow with the data (an equi-join on the cell, no nested loop). A cell multiplies block by block and keeps
the k best of each of its queries; a window merges the cells' lists.

Index form (``lsh_topk``). Each vector gets one code per table: the signs of its products with ``bits`` random directions. A
query meets the vectors that share a code with it in some table, or differ in one bit (multi-probe); those candidates
are scored exactly. Recall is measured in the tests (0.9 or more at the defaults); every vector is indexed.

Scores: null where a side is null, zero, of another dimension, or holds null or non-finite components; null scores come last,
ties go to the smaller id.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from shelfwise.operators.ranking import written

QUERY_BLOCK, CORPUS_BLOCK = 512, 4096
#: blocks on each side of a cell
CELL_QUERIES, CELL_CORPUS = 4, 8
NO_DIRECTION = -1
TABLES, BITS, LSH_SEED = 20, 8, 17


def _units(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(dimension, or ``NO_DIRECTION`` for vectors without one; unit vectors)."""
    dims, units = np.full(len(column), NO_DIRECTION), []
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    offsets = column.offsets.to_pylist()
    valid = column.is_valid().to_pylist()
    for i, (low, high) in enumerate(zip(offsets, offsets[1:])):
        x = flat[low:high]
        length = math.sqrt(float(x @ x)) if valid[i] else 0.0
        if length > 0 and math.isfinite(length):
            dims[i] = high - low
            units.append(x / length)
        else:
            units.append(None)
    return dims, units


def pack(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(dim, ids, matrix): rows of at most ``size`` vectors of one dimension; those without a direction have blocks of their own."""
    kind = vectors.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, units = held.pop(dim)
            raw = np.array(units).astype("<f8").tobytes() if dim != NO_DIRECTION else b""
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([raw], pa.binary())], names=["dim", "ids", "matrix"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            dims, units = _units(batch.column(1))
            for vec_id, dim, unit in zip(batch.column(0).to_pylist(), dims.tolist(), units):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                rows.append(unit)
                if len(ids) >= size:
                    yield made(dim)
        for dim in list(held):
            yield made(dim)

    read = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    schema = StructType([StructField("dim", IntegerType()), StructField("ids", ArrayType(kind)), StructField("matrix", BinaryType())])
    return read.mapInArrow(run, schema)


def _order(vec_id) -> tuple:
    """Sort key of an id: null first, as Spark sorts."""
    return (vec_id is not None, vec_id)


class TopK:
    """The k best (score, id) of a query; a null score counts as lowest."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def bar(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.k else -math.inf

    def offer(self, score: float | None, vec_id) -> None:
        insort(self.rows, (math.inf if score is None else -score, _order(vec_id), vec_id, score), key=lambda r: r[:2])
        del self.rows[self.k:]


def exact_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id_col: str, query_vec_col: str,
               k: int, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k most similar corpus rows of every query row, by cosine.

    Both sides are packed and written when called; the products run when the result is read. Every query row gets its own list
    (``slot``), whatever its id.
    """
    id_type = corpus.schema[id_col].dataType
    numbered = written(queries.select(F.monotonically_increasing_id().alias("slot"), F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("v")), "queries")
    left = written(pack(numbered, "slot", "v", query_block), "query-blocks")
    right = written(pack(corpus, id_col, vec_col, corpus_block), "corpus-blocks")
    across, down = -(-max(left.count(), 1) // CELL_QUERIES), -(-max(right.count(), 1) // CELL_CORPUS)

    def side(blocks: DataFrame, own: str, own_groups: int, other: str, other_groups: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("ids"), F.lit(own_groups)).cast("int").alias(own)
        return blocks.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1))).alias(other))

    q = side(left, "across", across, "down", down).select("across", "down", F.col("dim").alias("q_dim"), F.col("ids").alias("slots"), F.col("matrix").alias("q_matrix"))
    cells = q.join(side(right, "down", down, "across", across), ["across", "down"]).select("q_dim", "slots", "q_matrix", "dim", "ids", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, TopK] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                q_dim, slots, q_raw, dim, ids, raw = (c[i].as_py() for c in batch.columns)
                lists.update({s: TopK(k) for s in slots if s not in lists})
                if q_dim != dim or dim == NO_DIRECTION:
                    first = sorted(ids, key=_order)[:k]
                    for slot in slots:
                        if len(lists[slot].rows) < k or lists[slot].rows[-1][3] is None:
                            for vec_id in first:
                                lists[slot].offer(None, vec_id)
                    continue
                x, c = np.frombuffer(q_raw, "<f8").reshape(len(slots), dim), np.frombuffer(raw, "<f8").reshape(len(ids), dim)
                scores = x @ c.T
                cut = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(slots), -math.inf)
                for slot, row, low in zip(slots, scores, cut.tolist()):
                    best = lists[slot]
                    for j in np.flatnonzero(row >= max(low, best.bar())).tolist():
                        best.offer(float(row[j]), ids[j])
        if kind is not None:
            rows = [(s, r[2], r[3]) for s, best in lists.items() for r in best.rows]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], names=["slot", "id", "score"])

    found = cells.mapInArrow(run, StructType([numbered.schema["slot"], StructField("id", id_type), StructField("score", DoubleType())]))
    return _merged(found, numbered, id_col, k)


def _merged(found: DataFrame, numbered: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best of each query row over the lists of all cells, under the queries' own ids."""
    w = Window.partitionBy("slot").orderBy(F.desc_nulls_last("score"), F.asc("id"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(numbered.select("slot", "query_id"), "slot").select("query_id", F.col("id").alias(id_col), "score", "rank")


def _codes(vectors: DataFrame, tables: int, bits: int, seed: int, probes: bool) -> DataFrame:
    """(id, unit, dim, tab, code) for every vector with a direction: its code in each table, with ``probes`` also those one bit away."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, units = _units(batch.column(1))
            for dim in set(dims.tolist()) - {NO_DIRECTION}:
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).normal(size=(tables * bits, dim))
                x = np.array([units[i] for i in at])
                signs = (x @ planes[dim].T > 0).reshape(len(at), tables, bits)
                code = (signs * (1 << np.arange(bits))).sum(axis=2)
                if probes:
                    code = np.concatenate([code[:, :, None], code[:, :, None] ^ (1 << np.arange(bits))], axis=2)
                else:
                    code = code[:, :, None]
                each = code.shape[1] * code.shape[2]
                rows = np.repeat(at, each)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), dim), pa.int32()),
                                       pa.array(np.tile(np.repeat(np.arange(tables), code.shape[2]), len(at)), pa.int32()),
                                       pa.array(code.reshape(-1), pa.int32())], names=["id", "dim", "tab", "code"])

    kind = vectors.schema["id"]
    return vectors.select("id", "v").mapInArrow(run, StructType([kind, *[StructField(c, IntegerType()) for c in ("dim", "tab", "code")]]))


def lsh_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id_col: str, query_vec_col: str, k: int,
             tables: int = TABLES, bits: int = BITS, seed: int = LSH_SEED) -> DataFrame:
    """(query_id, id, score, rank) among the corpus rows that share a code with the query; fewer than k where fewer do.

    Corpus ids must be unique. Codes meet by an equi-join, pairs are scored once, and a query row's candidates are cut to k per task before they meet.
    """
    c = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    numbered = written(queries.select(F.monotonically_increasing_id().alias("slot"), F.col(query_id_col).alias("query_id"),
                                      F.col(query_vec_col).cast("array<double>").alias("v")), "queries")
    asked = _codes(numbered.select(F.col("slot").alias("id"), "v"), tables, bits, seed, probes=True).withColumnRenamed("id", "slot")
    pairs = asked.join(_codes(c, tables, bits, seed, probes=False), ["dim", "tab", "code"]).select("slot", "id").distinct()
    both = pairs.join(numbered.select("slot", F.col("v").alias("q")), "slot").join(c, "id")
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return _merged(both.select("slot", "id", (product / (norm("v") * norm("q"))).alias("score")), numbered, id_col, k)
