"""Hard negatives by maximum inner product search in cover trees.

An anchor's positives are its best-scoring rows of the same label; for each positive the
hard negatives are the best rows of other labels whose score lies in a window below the
positive's score. Scores are inner products of integer vectors.

Candidates are packed into blocks, and the task that packs a block builds its cover tree.
Each vector gets one more component that brings all of a tree to the same norm, so that the
order by inner product is the order by distance. A node covers its points within a radius
measured in that space; children are points of the node more than half of that radius apart
(level by level: nesting, covering, separation). For an anchor q every score below a node lies
within ``q.centre -+ |q| * radius``.

Anchors are packed into blocks too, and anchor blocks meet the trees on a grid of cells whose
two sides follow the measured numbers of blocks, so a cell's work stays bounded while cells
grow with the data. In a cell every anchor descends best-first: the node with the highest bound is
opened next, nodes whose bounds lie outside all windows or below what the lists already hold are skipped,
points are verified by their exact integer scores. One product scores a root's points for all anchors of
a block. A cell's lists are bounded (5 or 3 per list) and merged per anchor by a window.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no
part, nor do vectors whose scaled squared length reaches 2**61 (their scores would not fit a long). Vectors of
different dimension never meet. Repeated ids: an anchor id is searched for once, with its smallest (label,
vector); rows of the anchor's own id are never its positives; in one list an id stands once, with its best
score there. Ties go to the smaller id. Copies of a vector are kept once per tree with the few smallest ids that a list
can need, so hot copies cost nothing. A negative or zero positive score gives the window that the two
inequalities leave (none, or 0). An empty table gives no rows. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialize, release_memory

SCALE = 256
LABELS = 10
RELABEL_EVERY = 7
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOWEST_PERCENT, HIGHEST_PERCENT = 50, 95
TREE_POINTS = 2048
ANCHOR_BLOCK = 256
#: blocks on each side of a grid cell: the work of one task
CELL_TREES, CELL_ANCHORS = 4, 8
LEAF_POINTS = 16
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62

TREE_SCHEMA = "dim int, points binary, labels binary, ids binary, id_ends binary, nodes binary, radii binary"
ANCHOR_SCHEMA = "dim int, a_ids binary, a_labels binary, a_points binary, a_windows binary"
FOUND_SCHEMA = "anchor_id bigint, slot int, vec_id bigint, score bigint"
RESULT_SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, vectors in whole numbers, every seventh id's label moved on."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # rounded down in double first: sizes that a long cannot hold go before the cast
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale))
    small = rows.where(length < F.lit(2.0 ** 61))
    return small.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("int")))


def build_tree(points: np.ndarray, leaf: int = LEAF_POINTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cover tree over integer vectors: (order of the points, nodes, radii).

    A node is (centre, first loose point, end of loose points, first child, end of children); centre is a place in
    the new order. A node's loose points are those of its children that cover nothing else, and of leaves all points.
    """
    n = len(points)
    x = points.astype(float)
    square = (x * x).sum(axis=1)
    top = square.max()
    tail = np.sqrt(np.maximum(top - square, 0))  # the component that brings every vector to the same norm
    near = x @ x.T + np.outer(tail, tail)
    # rounding must never make a radius too small: 1e-9 of the squared norm is far above it
    apart = np.sqrt(np.maximum(2 * top - 2 * near, 0) + 1e-9 * top)
    del near
    order: list[int] = []
    place = np.empty(n, np.int64)
    nodes: list[list[int]] = [[0, 0, 0, 0, 0]]
    radii = [float(apart[0].max())]
    pending = [(0, 0, np.arange(n))]
    centres = [0]
    while pending:
        node, centre, members = pending.pop()
        reach = apart[centre, members]
        radius = float(reach.max())
        radii[node] = radius
        loose, children = [], []
        if len(members) <= leaf or radius <= np.sqrt(1e-9 * top) * 1.01:
            loose = members.tolist()
        else:
            left = np.concatenate([[centre], members[members != centre]])
            while left.size:
                covered = apart[left[0], left] <= radius / 2
                covered[0] = True
                child = left[covered]
                left = left[~covered]
                if child.size == 1:
                    loose.append(int(child[0]))
                else:
                    children.append(child)
        start = len(order)
        place[loose] = np.arange(start, start + len(loose))
        order += loose
        first = len(nodes)
        nodes[node] = [centre, start, start + len(loose), first, first + len(children)]
        for child in children:
            pending.append((len(nodes), int(child[0]), child))
            nodes.append([int(child[0]), 0, 0, 0, 0])
            radii.append(0.0)
            centres.append(int(child[0]))
    out = np.array(nodes, np.int64)
    out[:, 0] = place[out[:, 0]]
    return np.array(order, np.int64), out, np.array(radii)


def trees(rows: DataFrame, size: int = TREE_POINTS, keep: int = POSITIVES + 1) -> DataFrame:
    """One row per cover tree of at most ``size`` different (vector, label) pairs of one dimension.

    Of equal pairs the ``keep`` smallest ids stay: a list takes at most five, and the anchor itself may be among them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bytes, int], list[int]]] = {}

        def made(dim: int) -> pa.RecordBatch:
            found = held.pop(dim)
            keys = sorted(found)
            points = np.frombuffer(b"".join(k[0] for k in keys), "<i4").reshape(len(keys), dim)
            order, nodes, radii = build_tree(points)
            ids = [found[keys[i]] for i in order.tolist()]
            labels = np.array([keys[i][1] for i in order.tolist()], "<i8")
            parts = [points[order].astype("<i4"), labels, np.array([i for some in ids for i in some], "<i8"),
                     np.cumsum([len(some) for some in ids]).astype("<i8"), nodes.astype("<i8"), radii.astype("<f8")]
            return pa.record_batch([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                                   names=["dim", "points", "labels", "ids", "id_ends", "nodes", "radii"])

        try:
            for batch in batches:
                ids, labels, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
                ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
                start = 0
                for vec_id, label, end in zip(ids, labels, ends):
                    dim = end - start
                    of_dim = held.setdefault(dim, {})
                    some = of_dim.setdefault((flat[start:end].tobytes(), label), [])
                    if vec_id not in some:
                        insort(some, vec_id)
                        del some[keep:]
                    start = end
                    if len(of_dim) >= size:
                        yield made(dim)
            for dim in list(held):
                yield made(dim)
        finally:
            release_memory()

    return rows.select("vec_id", "label", "vector").mapInArrow(run, TREE_SCHEMA)


def anchor_blocks(rows: DataFrame, windows: int, size: int = ANCHOR_BLOCK) -> DataFrame:
    """Pack (vec_id, label, vector, lows, highs) into blocks of anchors of one dimension; every anchor has ``windows`` windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, labels, points, ranges = zip(*held.pop(dim))
            parts = [np.array(ids, "<i8"), np.array(labels, "<i8"), np.array(points, "<i4"), np.array(ranges, "<i8")]
            return pa.record_batch([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                                   names=["dim", "a_ids", "a_labels", "a_points", "a_windows"])

        for batch in batches:
            for vec_id, label, vector, lows, highs in zip(*(c.to_pylist() for c in batch.columns)):
                ranges = list(zip(lows, highs)) + [(1, 0)] * (windows - len(lows))  # an empty window fills the row
                held.setdefault(len(vector), []).append((vec_id, label, vector, ranges))
                if len(held[len(vector)]) >= size:
                    yield made(len(vector))
        for dim in list(held):
            yield made(dim)

    return rows.select("vec_id", "label", "vector", "lows", "highs").mapInArrow(run, ANCHOR_SCHEMA)


class Best:
    """The k best (score, id) of one window, best first, ties to the smaller id; an id stands once."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def bar(self) -> int:
        """Scores below it cannot enter."""
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low

    def offer(self, score: int, vec_id: int) -> None:
        entry = (-score, vec_id)
        if len(self.rows) == self.k and entry >= self.rows[-1]:
            return
        for i, (held, held_id) in enumerate(self.rows):
            if held_id == vec_id:
                if held <= -score:
                    return
                del self.rows[i]
                break
        insort(self.rows, entry)
        del self.rows[self.k:]


def exact_products(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products; in double precision where every partial sum is a whole number below 2**53."""
    reach = math.sqrt(float((q * q).sum(axis=-1).max(initial=0))) * math.sqrt(float((points * points).sum(axis=-1).max(initial=0)))
    if reach < 2.0 ** 52:
        return q @ points.T
    return (q.astype(np.int64).astype(object) @ points.astype(np.int64).astype(object).T).astype(np.int64)


class Tree:
    """A candidate block's cover tree, as the task reads it."""

    def __init__(self, dim: int, points: bytes, labels: bytes, ids: bytes, id_ends: bytes, nodes: bytes, radii: bytes):
        self.labels = np.frombuffer(labels, "<i8")
        self.points = np.frombuffer(points, "<i4").reshape(len(self.labels), dim).astype(float)
        self.ids, self.ends = np.frombuffer(ids, "<i8").tolist(), np.frombuffer(id_ends, "<i8").tolist()
        self.nodes, self.radii = np.frombuffer(nodes, "<i8").reshape(-1, 5), np.frombuffer(radii, "<f8")
        self.top = math.sqrt(float((self.points * self.points).sum(axis=1).max()))
        _, start, end, first, last = self.nodes[0]
        # what opening the root asks for: its loose points and its children's centres
        self.front = np.concatenate([np.arange(start, end), self.nodes[first:last, 0]])
        self.front_points = self.points[self.front]

    def offer(self, at: np.ndarray, scores: np.ndarray, label: int, anchor_id: int, same: bool, lists: list[Best]) -> int:
        """Verify points: offer those of fitting label and score to the lists."""
        fits = self.labels[at] == label if same else self.labels[at] != label
        for best in lists:
            inside = np.flatnonzero(fits & (scores >= best.bar()) & (scores <= best.high))
            for i in inside[np.argsort(-scores[inside], kind="stable")].tolist():
                if scores[i] < best.bar():
                    break  # best first: the rest is lower still
                point = int(at[i])
                for vec_id in self.ids[self.ends[point - 1] if point else 0:self.ends[point]]:
                    if not same or vec_id != anchor_id:
                        best.offer(int(scores[i]), vec_id)
        return len(at)

    def search(self, q: np.ndarray, front: np.ndarray, label: int, anchor_id: int, same: bool, lists: list[Best]) -> int:
        """Best-first descent for one anchor whose scores with the front are given; returns the points verified."""
        length = math.sqrt(float(q @ q))
        slack = 1e-9 * length * self.top + 1e-9
        _, start, end, first, last = self.nodes[0].tolist()
        verified = self.offer(self.front[:end - start], front[:end - start], label, anchor_id, same, lists)
        heap: list[tuple[float, float, int]] = []

        def push(children: range, scores: np.ndarray) -> None:
            for node, score in zip(children, scores.tolist()):
                way = length * self.radii[node] + slack
                heapq.heappush(heap, (-(score + way), score - way, node))

        push(range(first, last), front[end - start:])
        while heap:
            above, low, node = heapq.heappop(heap)
            high = -above
            bars = [best.bar() for best in lists]
            if high < min(bars):
                break  # no node that is left reaches any list
            if not any(high >= bar and low <= best.high for bar, best in zip(bars, lists)):
                continue  # outside all windows
            _, start, end, first, last = self.nodes[node].tolist()
            at = np.concatenate([np.arange(start, end), self.nodes[first:last, 0]])
            scores = exact_products(q[None], self.points[at])[0]
            verified += self.offer(at[:end - start], scores[:end - start], label, anchor_id, same, lists)
            push(range(first, last), scores[end - start:])
        return verified


def descend(anchors: DataFrame, candidates: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the k best candidates of each window of every anchor, over all trees.

    ``same`` asks for the anchor's label (without its own id), else for the other labels. The grid's two sides are the
    measured numbers of blocks over what one cell takes. The cells always meet in a shuffle: the planner knows the size of a side
    before its blocks are copied to their cells, and would broadcast many times that.
    """
    n_trees, n_anchors = candidates.count(), anchors.count()
    down, across = -(-max(n_trees, 1) // CELL_TREES), -(-max(n_anchors, 1) // CELL_ANCHORS)

    def side(blocks: DataFrame, column: str, own: str, own_groups: int, other: str, other_groups: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(column), F.lit(own_groups)).cast("int").alias(own)
        return blocks.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1))).alias(other))

    left = side(anchors, "a_ids", "across", across, "down", down)
    right = side(candidates, "ids", "down", down, "across", across)
    cells = left.hint("merge").join(right, ["dim", "across", "down"]).select(
        "dim", "a_ids", "a_labels", "a_points", "a_windows", "points", "labels", "ids", "id_ends", "nodes", "radii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[Best]] = {}
        asked: tuple[bytes, np.ndarray, list[int], list[int]] | None = None
        known: tuple[tuple, Tree] | None = None

        def leave() -> pa.RecordBatch:
            rows = [(anchor, slot, vec_id, -minus) for anchor, some in lists.items() for slot, best in enumerate(some) for minus, vec_id in best.rows]
            lists.clear()
            columns = list(zip(*rows)) or [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                   names=["anchor_id", "slot", "vec_id", "score"])

        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    dim, *raw = (batch.column(n)[i].as_py() for n in range(batch.num_columns))
                    if asked is None or asked[0] != raw[0]:
                        ids = np.frombuffer(raw[0], "<i8").tolist()
                        asked = raw[0], np.frombuffer(raw[2], "<i4").reshape(len(ids), dim).astype(float), ids, np.frombuffer(raw[1], "<i8").tolist()
                        if len(lists) > 50_000:
                            yield leave()
                    _, q, ids, labels = asked
                    for anchor, ranges in zip(ids, np.frombuffer(raw[3], "<i8").reshape(len(ids), windows, 2).tolist()):
                        if anchor not in lists:
                            lists[anchor] = [Best(k, low, high) for low, high in ranges]
                    if known is None or known[0] != (dim, *raw[4:7]):
                        known = (dim, *raw[4:7]), Tree(dim, *raw[4:])
                    tree = known[1]
                    front = exact_products(q, tree.front_points)
                    for at, (anchor, label) in enumerate(zip(ids, labels)):
                        tree.search(q[at], front[at], label, anchor, same, lists[anchor])
            yield leave()
        finally:
            release_memory()

    found = cells.mapInArrow(run, FOUND_SCHEMA).groupBy("anchor_id", "slot", "vec_id").agg(F.max("score").alias("score"))
    ranked = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest_percent: int = LOWEST_PERCENT,
                   highest_percent: int = HIGHEST_PERCENT, scale: int = SCALE, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """For each anchor (id divisible by ``anchor_every``) and each of its best positives the best negatives of the window.

    Trees, anchors and positives are written to the shared folder when called; the second search runs when the result is read.
    """
    rows = usable(embeddings, scale)
    candidates = materialize(trees(rows, keep=max(positives + 1, negatives)), "trees", wide=True)
    first = rows.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a"))
    anchors = materialize(first.select("vec_id", "a.label", "a.vector"), "anchors")
    everything = anchors.select("*", F.array(F.lit(NO_LOW)).alias("lows"), F.array(F.lit(NO_HIGH)).alias("highs"))
    best = descend(materialize(anchor_blocks(everything, 1), "anchor-blocks", wide=True), candidates, 1, positives, same=True)
    best = materialize(best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
                                   F.col("score").alias("positive_score")), "positives")
    # lowest * positive <= 100 * negative <= highest * positive, in decimals: scores may take up to 62 bits
    exact = F.col("positive_score").cast("decimal(28,0)")
    low = F.ceil(exact * lowest_percent / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    high = F.floor(exact * highest_percent / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    ranges = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", low.alias("low"), high.alias("high")))).alias("w"))
    windowed = anchors.join(ranges, anchors["vec_id"] == ranges["anchor_id"]).select(
        "vec_id", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = descend(materialize(anchor_blocks(windowed, positives), "windows", wide=True), candidates, positives, negatives, same=False)
    out = found.select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                       F.col("score").alias("negative_score")).join(best, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
