"""Exact centroid clustering (Lloyd rounds over integer vectors) with ns-bounds.

Every vector keeps, for each centroid, the distance of its last evaluation and the round
of that evaluation. The centroids of all rounds are retained. When centroids move, a
stored distance is loosened by the norm of the total displacement since that round,
``|c(t) - c(s)|``, and not by the sum of the per-round drifts: the upper bound of the own
centroid grows by it, the lower bounds of the others shrink by it. A vector whose upper
bound lies strictly below all its lower bounds keeps its centroid without any evaluation.
Where that fails, the own distance is evaluated first; the centroids whose lower bound does
not exceed it are then rescanned exactly, in integers, ties to the smaller number.

Vectors are packed into blocks (rows of packed bytes) that carry their bounds. A round is
one pass over the blocks without a shuffle: it writes the blocks with new bounds and, for
vectors that changed their centroid, what sums and counts gain and lose. Those are added up
per centroid and component by Spark; the driver sees at most ``k * (components + 1)`` sums a
round, as whole numbers of any size. A round reads only the files of the round before, in the
shared folder, and older files are deleted, so that lost executors cost their tasks alone and two copies
exist at most.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are
left out. Repeated rows take part one by one. A null ``vec_id`` has no hash: it is never a first centroid while others
exist, and takes part like any other row. Equal hashes (repeated ids) are ordered by the vector. Fewer vectors than ``k``: one
centroid each. Components of any size are handled as whole numbers; a squared distance or sum beyond a long is null. An empty table gives no
rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import delete_path, read_written, release_memory, write_scratch

COMPONENTS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
BLOCK = 2048
#: below this size of a component squared distances of 64 components fit 64-bit integers
WIDE = 1 << 27
LIMB = 40
FAR = 10 ** 300
UP, DOWN = 1 + 1e-9, 1 - 1e-9

BLOCK_SCHEMA = ("ids array<bigint>, wide boolean, x binary, near binary, dist binary, seen binary, "
                "sums array<struct<cluster:int,position:int,limb:int,value:bigint>>")
ROW_SCHEMA = "vec_id bigint, cluster int, distance bigint"
RESULT_SCHEMA = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
SUM_TYPE = pa.list_(pa.struct([("cluster", pa.int32()), ("position", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))


def usable(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") == components) & finite)


def whole(value: float, scale: int = SCALE) -> int:
    """floor(scale * value) as a whole number of any size."""
    return math.floor(value) * scale if abs(value) > 1e18 else math.floor(value * scale)


def as_integers(raw: bytes, wide: bool, rows: int, scale: int) -> np.ndarray:
    """The integer vectors of a block; Python integers where 64 bits do not do."""
    if not wide:
        return np.frombuffer(raw, "<i4").reshape(rows, -1).astype(np.int64)
    values = np.frombuffer(raw, "<f8").reshape(rows, -1)
    return np.array([[whole(v, scale) for v in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def squares(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the centroid."""
    if x.dtype != object and max(map(abs, centroid), default=0) < WIDE:
        diff = x - np.array(centroid, np.int64)
        return np.einsum("ij,ij->i", diff, diff)
    diff = x.astype(object) - np.array(centroid, dtype=object)
    return (diff * diff).sum(axis=1)


def root(square) -> float:
    """Square root of a whole number of any size; sizes beyond ``FAR`` count as that."""
    return math.sqrt(min(int(square), FAR))


def roots(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square) if square.dtype != object else np.array([root(s) for s in square.tolist()])


def displacements(history: list[list[list[int]]]) -> np.ndarray:
    """moved[s, j]: length of the way of centroid j from round s to the last round, as the crow flies."""
    def way(c: list[int], d: list[int]) -> float:
        square = sum((a - b) ** 2 for a, b in zip(c, d))
        return root(square) if square < FAR else math.inf

    return np.array([[way(c, d) for c, d in zip(then, history[-1])] for then in history])


class Bounds:
    """Assignment and stored distances of a block's vectors: distance and round of each vector's last evaluations."""

    def __init__(self, near: np.ndarray, dist: np.ndarray, seen: np.ndarray):
        self.near, self.dist, self.seen = near, dist, seen

    @classmethod
    def none(cls, rows: int, k: int) -> Bounds:
        return cls(np.full(rows, -1, np.int64), np.zeros((rows, k)), np.zeros((rows, k), np.int64))

    @classmethod
    def unpack(cls, near: bytes, dist: bytes, seen: bytes, rows: int, k: int) -> Bounds:
        if not near:
            return cls.none(rows, k)
        return cls(np.frombuffer(near, "<i2").astype(np.int64), np.frombuffer(dist, "<f8").reshape(rows, k).copy(),
                   np.frombuffer(seen, "<i2").reshape(rows, k).astype(np.int64))

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return self.near.astype("<i2").tobytes(), self.dist.astype("<f8").tobytes(), self.seen.astype("<i2").tobytes()


def assign(x: np.ndarray, bounds: Bounds, history: list[list[list[int]]], moved: np.ndarray) -> tuple[Bounds, int]:
    """The nearest current centroid of every vector, and how many distances were evaluated."""
    rows, k, now = len(x), len(history[-1]), len(history) - 1
    near, dist, seen = bounds.near.copy(), bounds.dist, bounds.seen
    each = np.arange(rows)
    evaluated = 0
    if rows and near[0] < 0:
        need = np.ones((rows, k), bool)
    else:
        drift = moved[seen, np.arange(k)] * UP
        upper = dist[each, near] * UP + drift[each, near]
        upper[dist[each, near] >= root(FAR) * DOWN] = np.inf
        lower = dist * DOWN - drift
        lower[each, near] = np.inf
        failed = np.flatnonzero(~(upper < lower.min(axis=1)))
        for j in range(k):  # the own distance first: it often settles the matter
            own = failed[near[failed] == j]
            if own.size:
                dist[own, j] = roots(squares(x[own], history[-1][j]))
                seen[own, j] = now
                upper[own] = dist[own, j] * UP
                evaluated += own.size
        upper[dist[each, near] >= root(FAR) * DOWN] = np.inf
        need = np.zeros((rows, k), bool)
        need[failed] = lower[failed] <= upper[failed, None]
        need[each, near] = need.any(axis=1)
    best = np.full(rows, None, dtype=object) if x.dtype == object else np.full(rows, -1, np.int64)
    for j in range(k):
        asked = np.flatnonzero(need[:, j])
        if not asked.size:
            continue
        square = squares(x[asked], history[-1][j])
        if square.dtype == object and best.dtype != object:
            best = best.astype(object)
        evaluated += asked.size
        dist[asked, j] = roots(square)
        seen[asked, j] = now
        held = best[asked]
        first = np.array([h is None or h < 0 for h in held.tolist()], bool) if best.dtype == object else held < 0
        nearer = first.copy()
        nearer[~first] = (square[~first] < held[~first]).astype(bool)
        best[asked[nearer]] = square[nearer]
        near[asked[nearer]] = j
    return Bounds(near, dist, seen), evaluated


def gains(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """What the sums (and, at the position after the last component, the counts) of the centroids gain by the new assignment."""
    out: list[dict] = []
    changed = before != after
    for j in range(k):
        come, gone = x[changed & (after == j)], x[changed & (before == j)]
        totals = [int(a) - int(b) for a, b in zip(come.sum(axis=0), gone.sum(axis=0))] + [len(come) - len(gone)]
        for position, total in enumerate(totals):
            if abs(total) < 1 << 62:
                limbs = [total]
            else:
                sign, rest, limbs = (1 if total > 0 else -1), abs(total), []
                while rest:
                    limbs.append(sign * (rest & ((1 << LIMB) - 1)))
                    rest >>= LIMB
            out += [{"cluster": j, "position": position, "limb": i, "value": v} for i, v in enumerate(limbs) if v]
    return out


def blocks(rows: DataFrame, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """Pack (vec_id, vector) into blocks of integer vectors without bounds; vectors of wide components have blocks of their own."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                lists = batch.column(1)
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                wide = (np.abs(x) >= WIDE / scale).any(axis=1)
                for is_wide in (False, True):
                    of = np.flatnonzero(wide == is_wide)
                    for at in range(0, len(of), size):
                        part = of[at:at + size]
                        raw = x[part].astype("<f8") if is_wide else np.floor(x[part] * scale).astype("<i4")
                        ids = pa.array([batch.column(0).take(pa.array(part)).to_pylist()], pa.list_(pa.int64()))
                        yield pa.record_batch([ids, pa.array([is_wide]), pa.array([raw.tobytes()], pa.binary()), *[pa.array([b""], pa.binary())] * 3,
                                               pa.array([[]], SUM_TYPE)], names=["ids", "wide", "x", "near", "dist", "seen", "sums"])
        finally:
            release_memory()

    return rows.mapInArrow(pack, BLOCK_SCHEMA)


def _block_rows(batch: pa.RecordBatch, k: int, scale: int):
    """(ids column, wide, raw vectors, integer vectors, bounds) of each block of a batch."""
    for i in range(batch.num_rows):
        ids = batch.column(0).slice(i, 1)
        wide, raw, near, dist, seen = (batch.column(n)[i].as_py() for n in range(1, 6))
        n = len(ids[0])
        yield ids, wide, raw, as_integers(raw, wide, n, scale), Bounds.unpack(near, dist, seen, n, k)


def round_pass(table: DataFrame, history: list[list[list[int]]], scale: int) -> DataFrame:
    """The blocks with bounds and assignments for the last centroids of ``history``, and what the sums gain."""
    moved, k = displacements(history), len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, wide, raw, x, bounds in _block_rows(batch, k, scale):
                new, _ = assign(x, bounds, history, moved)
                packed = [pa.array([b], pa.binary()) for b in new.pack()]
                yield pa.record_batch([ids, pa.array([wide]), pa.array([raw], pa.binary()), *packed, pa.array([gains(x, bounds.near, new.near, k)], SUM_TYPE)],
                                      names=["ids", "wide", "x", "near", "dist", "seen", "sums"])

    return table.mapInArrow(run, BLOCK_SCHEMA)


def last_pass(table: DataFrame, history: list[list[list[int]]], scale: int) -> DataFrame:
    """(vec_id, cluster, distance) for the last centroids of ``history``."""
    moved, k = displacements(history), len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, x, bounds in _block_rows(batch, k, scale):
                near = assign(x, bounds, history, moved)[0].near
                distance: list = [None] * len(x)
                for j in range(k):
                    own = np.flatnonzero(near == j)
                    for i, square in zip(own.tolist(), squares(x[own], history[-1][j]).tolist()):
                        distance[i] = square if square < 1 << 63 else None
                yield pa.record_batch([ids.flatten(), pa.array(near, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, ROW_SCHEMA)


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes: a top-k, so at most ``k`` rows reach the driver."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(hashed.alias("h"), "vector").orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return [[whole(v, scale) for v in r.vector] for r in first]


def as_long(total: int | None) -> int | None:
    return total if total is not None and total < 1 << 63 else None


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE,
            seed: int = SEED) -> DataFrame:
    """Cluster the vectors; every row with its centroid's number, squared distance, inertias and the hash of the centroid.

    Runs ``rounds`` rounds when called and leaves the assignment in the shared folder; the result is lazy from there on.
    """
    spark = embeddings.sparkSession
    kept = usable(embeddings, components)
    history = [first_centroids(kept, k, scale, seed)]
    if not history[0]:
        return spark.createDataFrame([], RESULT_SCHEMA)
    k = len(history[0])
    path = write_scratch(blocks(kept, scale), "vectors")
    totals = [[0] * (components + 1) for _ in range(k)]
    for _ in range(rounds):
        new = write_scratch(round_pass(read_written(spark, path, BLOCK_SCHEMA), history, scale), "bounds")
        delete_path(spark, path)
        path = new
        gained = read_written(spark, path, BLOCK_SCHEMA).select(F.explode("sums").alias("s")).select("s.*")
        for r in gained.groupBy("cluster", "position", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            totals[r.cluster][r.position] += int(r.value) << (LIMB * r.limb)
        history.append([[s // t[-1] for s in t[:-1]] if t[-1] else c for c, t in zip(history[-1], totals)])
    assigned_path = write_scratch(last_pass(read_written(spark, path, BLOCK_SCHEMA), history, scale), "clusters")
    delete_path(spark, path)
    assigned = read_written(spark, assigned_path, ROW_SCHEMA)
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"),
                                            F.count_if(F.col("distance").isNull()).alias("missing")).collect()
    sums: list[int | None] = [0] * k
    for r in found:
        sums[r.cluster] = None if r.missing else int(r.total)
    inertia = None if None in sums else as_long(sum(sums))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1]]
    return assigned.select("vec_id", "cluster", "distance",
                           F.array(*[F.lit(as_long(s)).cast("bigint") for s in sums])[F.col("cluster")].alias("cluster_inertia"),
                           F.lit(inertia).cast("bigint").alias("inertia"),
                           F.array(*[F.lit(h) for h in hashes])[F.col("cluster")].alias("centroid_sha256"))
