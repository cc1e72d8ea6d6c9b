"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks (rows of packed bytes) of one dimension each. Query
blocks and candidate blocks are dealt to groups, and the cells of the grid (query group, candidate
group) are the keys of a block matrix join: a candidate block is sent once to each query group, a query
block once to each candidate group, and in a cell every pair of blocks meets. The numbers of
groups follow the counted rows of the dimension, so cells grow with the data on both sides.
A joined row is a tile, taken in strips of ``STRIP`` queries. In a strip

1. both blocks are quantised to int8, one scale per vector, and multiplied; the products
   are whole numbers below 2**24 and therefore exact in float32,
2. the quantisation errors ``e = |x - s*x8|`` of both sides bound every true distance:
   ``|d - d8| <= e_query + e_candidate`` by the triangle inequality,
3. a pair survives when its lower bound does not exceed the k-th smallest upper bound of its
   query (in this tile, or the k-th best distance an earlier tile of the task left in the heap),
4. survivors are recomputed in double precision on the original vectors.

Every query keeps a heap of its k best; a task's heaps leave it at its end and are merged per
query. The bounds are proven, so the result equals brute force: no recall is lost.
Where squares could overflow or vanish, a tile is scaled by a power of two, which is exact; a distance
beyond the largest double is infinite.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do rows with a null id; vectors of another dimension are never compared. A
candidate with the query's own id is left out; repeated rows of an id give one answer
each (queries: the smallest vector of the id; candidates: the nearest). Ties go to the
smaller id. Fewer candidates than k: all of them. Empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 10
QUERY_EVERY = 100
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
#: blocks of either side in a full group
GROUP_BLOCKS = 8
#: below this number every candidate block is a group of its own
CANDIDATE_GROUPS = 64
STRIP = 256
#: squares of numbers within these bounds neither overflow nor vanish
SAFE = (1e-140, 1e140)
#: more than underflowing squares can take from a distance
LEAST = 1e-150

BLOCK_SCHEMA = "dim int, ids binary, vectors binary"
FOUND_SCHEMA = "query_id bigint, vec_id bigint, score double"
RESULT_SCHEMA = "query_id bigint, rank int, vec_id bigint, score double"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack (vec_id, vector) into rows of at most ``size`` vectors of equal dimension."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[list, list]] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, vectors = open_blocks.pop(dim)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                                    pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, dims = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            ends = np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                rows_of = np.flatnonzero(dims == dim)
                values = flat[(ends[rows_of] - dim)[:, None] + np.arange(dim)]
                at = 0
                while at < len(rows_of):
                    have = open_blocks.setdefault(dim, ([], []))
                    room = size - sum(map(len, have[0]))
                    have[0].append(ids[rows_of[at:at + room]])
                    have[1].append(values[at:at + room])
                    at += room
                    if sum(map(len, have[0])) >= size:
                        yield made(dim)
        for dim in list(open_blocks):
            yield made(dim)

    return rows.mapInArrow(pack, BLOCK_SCHEMA)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale per vector, proven bound of the rounding error's length per vector)."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    rest = x - codes * scale[:, None]
    error = np.sqrt((rest * rest).sum(axis=1))
    return codes, scale, error


def tile_bounds(query, candidate) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile from the int8 product of two quantised blocks."""
    (q8, qs, qe), (c8, cs, ce) = query, candidate
    # products of at most 1,000 codes stay below 2**24 and are exact in float32
    dot = np.zeros((len(q8), len(c8)))
    for at in range(0, q8.shape[1], 1000):
        dot += q8[:, at:at + 1000].astype(np.float32) @ c8[:, at:at + 1000].astype(np.float32).T
    dot *= qs[:, None]
    dot *= cs[None, :]
    q2 = (q8.astype(float) ** 2).sum(axis=1) * qs * qs
    c2 = (c8.astype(float) ** 2).sum(axis=1) * cs * cs
    near = q2[:, None] + c2[None, :] - 2 * dot
    # the sums above round as well: widen by that before the square root
    slack = 1e-12 * (q2[:, None] + c2[None, :])
    both = qe[:, None] + ce[None, :]
    low = np.sqrt(np.maximum(near - slack, 0)) - both
    high = np.sqrt(np.maximum(near + slack, 0)) + both
    return low * (1 - 1e-12) - LEAST, high * (1 + 1e-12) + LEAST


def distances(diff: np.ndarray) -> np.ndarray:
    """Lengths of the rows; rows whose squares would overflow or vanish are scaled by their largest component."""
    with np.errstate(over="ignore", under="ignore"):
        found = np.sqrt((diff * diff).sum(axis=1))
    top = np.abs(diff).max(axis=1)
    odd = np.flatnonzero((top > 0) & np.isfinite(top) & ((top < SAFE[0]) | (top > SAFE[1])))
    if odd.size:
        part = diff[odd] / top[odd, None]
        with np.errstate(over="ignore"):
            found[odd] = top[odd] * np.sqrt((part * part).sum(axis=1))
    return found


def shift_of(queries: np.ndarray, candidates: np.ndarray) -> int:
    """The power of two that brings a tile's largest component to about 1; 0 where nothing can overflow or vanish."""
    top = max(np.abs(queries).max(), np.abs(candidates).max())
    return 0 if SAFE[0] <= top <= SAFE[1] else int(np.frexp(top)[1])


class Nearest:
    """A heap of the k best (distance, id) of one query; the worst lies on top. Ids occur once."""

    def __init__(self, k: int):
        self.k, self.heap, self.best = k, [], {}

    def limit(self) -> float:
        return -self.heap[0][0] if len(self.heap) == self.k else np.inf

    def offer(self, distance: float, vec_id: int) -> None:
        held = self.best.get(vec_id)
        if held is not None:
            if distance >= held:
                return
            self.heap.remove((-held, -vec_id))
            heapq.heapify(self.heap)
            del self.best[vec_id]
        entry = (-distance, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            gone = heapq.heapreplace(self.heap, entry)
            del self.best[-gone[1]]
        else:
            return
        self.best[vec_id] = distance

    def ranked(self) -> list[tuple[float, int]]:
        return sorted((d, v) for v, d in self.best.items())


def search_tile(query_ids, queries, candidate_ids, candidates, heaps: dict[int, Nearest], k: int) -> None:
    """Offer the tile's surviving pairs to the queries' heaps."""
    shift = shift_of(queries, candidates)
    codes = quantise(np.ldexp(candidates, -shift) if shift else candidates)
    # repeated rows of an id count once, so their copies must not crowd out the k-th neighbour
    bounded = k < len(candidate_ids) == len(np.unique(candidate_ids))
    for at in range(0, len(query_ids), STRIP):
        ids, strip = query_ids[at:at + STRIP], queries[at:at + STRIP]
        low, high = tile_bounds(quantise(np.ldexp(strip, -shift) if shift else strip), codes)
        if shift:
            with np.errstate(over="ignore", under="ignore"):
                low, high = np.ldexp(low, shift), np.ldexp(high, shift)
        own = ids[:, None] == candidate_ids[None, :]
        high[own] = np.inf
        low[own] = np.inf
        kth = np.partition(high, k - 1, axis=1)[:, k - 1] if bounded else np.full(len(ids), np.inf)
        for i, query_id in enumerate(ids.tolist()):
            heap = heaps.setdefault(query_id, Nearest(k))
            alive = np.flatnonzero(low[i] <= min(kth[i], heap.limit()))
            alive = alive[candidate_ids[alive] != query_id]
            if not alive.size:
                continue
            with np.errstate(over="ignore"):
                distance = distances(candidates[alive] - strip[i])
            order = np.lexsort((candidate_ids[alive], distance))
            for j in order.tolist():
                if len(heap.heap) == k and (distance[j], candidate_ids[alive[j]]) > (-heap.heap[0][0], -heap.heap[0][1]):
                    break
                heap.offer(float(distance[j]), int(candidate_ids[alive[j]]))


def grid(asked: DataFrame, everyone: DataFrame, query_block: int, candidate_block: int, groups: int) -> DataFrame:
    """Per dimension: q_groups and c_groups, the sides of the grid, from the counted rows of both sides."""
    def counted(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    full = counted(asked, query_block, "q").join(counted(everyone, candidate_block, "c"), "dim")
    return full.select("dim", F.ceil(F.col("q") / GROUP_BLOCKS).cast("int").alias("q_groups"),
                       F.greatest(F.least("c", F.lit(groups)), F.ceil(F.col("c") / GROUP_BLOCKS).cast("int")).alias("c_groups"))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK,
            candidate_block: int = CANDIDATE_BLOCK, groups: int = CANDIDATE_GROUPS) -> DataFrame:
    """The k nearest rows of ``embeddings`` for every row of ``queries`` (vec_id, embedding), nearest first.

    Nearness is the Euclidean distance. ``groups``: up to that many candidate blocks, each is a group of its own.
    """
    everyone = usable(embeddings)
    asked = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sides = grid(asked, everyone, query_block, candidate_block, groups)
    # a lost task must pack the same blocks again, so rows that come from a shuffle are sorted first
    left = blocks(asked.repartition("vec_id").sortWithinPartitions("vec_id"), query_block).join(sides, "dim").select(
        "dim", F.pmod(F.xxhash64("ids"), F.col("q_groups")).cast("int").alias("q_group"),
        F.explode(F.sequence(F.lit(0), F.col("c_groups") - 1)).alias("c_group"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    right = blocks(everyone, candidate_block).join(sides, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("q_groups") - 1)).alias("q_group"),
        F.pmod(F.xxhash64("ids"), F.col("c_groups")).cast("int").alias("c_group"), "ids", "vectors")
    tiles = left.join(right, ["dim", "q_group", "c_group"]).select("q_ids", "q_vectors", "ids", "vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Nearest] = {}
        seen: tuple[bytes, np.ndarray] | None = None

        def leave() -> pa.RecordBatch:
            rows = [(q, v, d) for q, heap in heaps.items() for d, v in heap.ranked()]
            heaps.clear()
            cols = list(zip(*rows)) or [[], [], []]
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                   names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                raw = [batch.column(n)[row].as_py() for n in ("q_ids", "q_vectors", "ids", "vectors")]
                ids = np.frombuffer(raw[0], "<i8")
                if seen is None or seen[0] != raw[0]:
                    seen = (raw[0], np.frombuffer(raw[1], "<f8").reshape(len(ids), -1))
                    if len(heaps) > 50_000:
                        yield leave()
                c_ids = np.frombuffer(raw[2], "<i8")
                c = np.frombuffer(raw[3], "<f8").reshape(len(c_ids), -1)
                search_tile(ids, seen[1], c_ids, c, heaps, k)
        yield leave()

    found = tiles.mapInArrow(search, FOUND_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap, rows = None, Nearest(k), []

        def close() -> None:
            rows.extend((current, r, v, d) for r, (d, v) in enumerate(heap.ranked(), 1))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 4
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                                   names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query_id, vec_id, score in zip(*(c.to_pylist() for c in batch.columns)):
                if query_id != current:
                    if current is not None:
                        close()
                    current, heap = query_id, Nearest(k)
                heap.offer(score, vec_id)
            yield out()
        if current is not None:
            close()
        yield out()

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, RESULT_SCHEMA)
