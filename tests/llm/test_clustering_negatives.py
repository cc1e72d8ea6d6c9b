"""Ns-bounds clustering and cover-tree negatives against plain brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest

from shelfwise.llm import clustering, negatives
from shelfwise.llm.common import materialize
from shelfwise.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>, label int, distance string, cluster string"


def lloyd(rows, k, rounds, components=4, scale=clustering.SCALE, seed=clustering.SEED):
    """Every round assigns all vectors to all centroids, in Python integers."""
    kept = [(i, tuple(math.floor(v) * scale if abs(v) > 1e18 else math.floor(v * scale) for v in x)) for i, x, *_ in rows
            if x is not None and len(x) == components and all(v is not None and math.isfinite(v) for v in x)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def assign():
        return [min(range(len(centroids)), key=lambda j: (square(x, centroids[j]), j)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), n in zip(kept, near) if n == j]
            if own:
                centroids[j] = tuple(sum(c) // len(own) for c in zip(*own))
    near = assign()
    out = []
    total = sum(square(x, centroids[n]) for (_, x), n in zip(kept, near))
    for (i, x), n in zip(kept, near):
        inertia = sum(square(y, centroids[n]) for (_, y), m in zip(kept, near) if m == n)
        out.append((i, n, square(x, centroids[n]), inertia, total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, label, "d", None) for i, x, label in rows], VECTORS)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def ran(df):
    return in_order(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_rounds(spark, seed):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in rng.choice(middles)], 0) for i in range(300)]
    rows += [(i, [rng.randint(-1, 1) / 4 for _ in range(4)], 0) for i in range(300, 360)]  # ties and copies
    df = frame(spark, rows).repartition(3)
    got = ran(clustering.cluster(df, k=5, rounds=6, components=4))
    assert got == in_order(lloyd(rows, 5, 6))


def test_cluster_edge_cases(spark):
    good = [(1, [0.5, 0.25, -1.0, 2.0], None), (2, [0.5, 0.25, -1.0, 2.0], 3), (2, [9.0, 9.0, 9.0, 9.0], 3), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    bad = [(5, None, 1), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [1.0, float("nan"), 1.0, 1.0], 1),
           (10, [1.0, float("inf"), 1.0, 1.0], 1)]
    assert ran(clustering.cluster(frame(spark, good + bad), k=3, rounds=4, components=4)) == in_order(lloyd(good, 3, 4))
    assert ran(clustering.cluster(frame(spark, good[:2]), k=3, rounds=2, components=4)) == in_order(lloyd(good[:2], 3, 2))
    assert ran(clustering.cluster(frame(spark, bad), components=4)) == []
    assert ran(clustering.cluster(frame(spark, good).where("false"), components=4)) == []


def test_cluster_of_wide_numbers(spark):
    """Components of any size are exact; what no long can hold is null."""
    rows = [(i, [float(i), 2.0 ** 40 + i * 2.0 ** 20, -3.5, 0.0], 0) for i in range(12)] + [(20 + i, [1e300, i * 1e300, 0.0, -1e200], 0) for i in range(3)]
    rows += [(40 + i, [0.25 * i, 1.0, 1.0, 1.0], 0) for i in range(12)]
    want = [(i, n, *(v if v < 1 << 63 else None for v in (d, own, total)), h) for i, n, d, own, total, h in lloyd(rows, 4, 5)]
    assert ran(clustering.cluster(frame(spark, rows), k=4, rounds=5, components=4)) == in_order(want)


def test_bounds_save_evaluations():
    """Most vectors keep their centroid without an evaluation once the centroids move little."""
    rng = np.random.default_rng(4)
    x = np.floor(1024 * (rng.normal(size=(6, 16))[rng.integers(0, 6, 2000)] + 0.1 * rng.normal(size=(2000, 16)))).astype(np.int64)
    history = [[list(map(int, x[i])) for i in range(6)]]
    bounds, spent = clustering.Bounds.none(len(x), 6), []
    for _ in range(8):
        bounds, evaluated = clustering.assign(x, bounds, history, clustering.displacements(history))
        spent.append(evaluated)
        exact = np.stack([clustering.squares(x, c) for c in history[-1]], axis=1)
        assert np.array_equal(bounds.near, exact.argmin(axis=1))
        history.append([[int(v) for v in x[bounds.near == j].sum(axis=0) // max(1, (bounds.near == j).sum())] for j in range(6)])
    assert spent[0] == 6 * len(x) and spent[-1] < 0.5 * len(x)


def test_displacement_is_the_direct_way():
    history = [[[0, 0]], [[30, 0]], [[0, 40]], [[0, 0]]]
    assert clustering.displacements(history)[:, 0].tolist() == [0.0, 30.0, 40.0, 0.0]


def mined(rows, scale=negatives.SCALE, every=negatives.ANCHOR_EVERY):
    """All anchors against all rows (distinct ids)."""
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(v * scale) for v in x]) for i, x, label in rows
            if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, y, q in kept:
        if a % every:
            continue
        scored = sorted((-sum(u * v for u, v in zip(q, x)), i, label) for i, label, x in kept if i != a and len(x) == len(q))
        for minus, p, _ in [s for s in scored if s[2] == y][:5]:
            window = [(i, -m) for m, i, label in scored if label != y and 50 * -minus <= 100 * -m <= 95 * -minus][:3]
            out += [(a, p, rank, i, -minus, s) for rank, (i, s) in enumerate(window, 1)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(negatives, "CELL_TREES", 2)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 1)
    monkeypatch.setattr(negatives, "TREE_POINTS", 60)
    middles = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(8)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)], rng.randint(0, 9)) for i in range(0, 500)]
    rows += [(i, [float(rng.randint(-1, 1)) for _ in range(5)], rng.randint(0, 2)) for i in range(500, 650)]  # many ties and copies
    rows += [(i, [0.5] * 5, rng.randint(0, 1)) for i in range(650, 800)]  # one hot vector
    got = ran(negatives.hard_negatives(frame(spark, rows).repartition(4)))
    assert got == in_order(mined(rows))


def test_negative_edge_cases(spark):
    rows = [(0, [1.0, 1.0], 1), (50, [1.0, -1.0], 1), (3, [0.5, 0.5], 1), (4, [0.7, 0.7], 2), (5, [0.4, 0.0], 2), (-50, [-1.0, 0.0], 1), (8, [3.0], 2),
            (100, [], 1), (101, [], 1), (102, [], 2)]
    bad = [(1, None, 1), (2, [1.0, None], 1), (None, [1.0, 1.0], 2), (9, [1.0, float("nan")], 2), (10, [1.0, 1.0], None), (11, [1e30, 1.0], 2)]
    assert ran(negatives.hard_negatives(frame(spark, rows + bad))) == in_order(mined(rows))
    assert ran(negatives.hard_negatives(frame(spark, bad))) == []
    assert ran(negatives.hard_negatives(frame(spark, rows).where("false"))) == []
    # repeated rows: an id stands once in a list, an anchor is searched for once
    assert ran(negatives.hard_negatives(frame(spark, rows + rows))) == in_order(mined(rows))


def test_cells_are_not_broadcast(spark):
    """The planner knows a side's size only before its blocks are copied to the cells; joins of the cells shuffle at any size."""
    rows = negatives.usable(frame(spark, [(i, [float(i % 7), float(i % 5)], i % 3) for i in range(200)]))
    blocks = negatives.anchor_blocks(rows.selectExpr("*", "array(0L) lows", "array(9L) highs"), 1, size=20)
    found = negatives.descend(materialize(blocks, "test-blocks"), materialize(negatives.trees(rows, size=50), "test-trees"), 1, 3, same=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim" in plan and "BroadcastHashJoin [dim" not in plan


def test_blocks_are_read_in_small_groups(spark, monkeypatch):
    """A reader holds a row group's rows at once: no group of trees is large, whatever their number."""
    monkeypatch.setattr(negatives.trees, "__defaults__", (10, 6))
    written = []

    def kept(df, name, **options):
        written.append((name, materialize(df, name, **options)))
        return written[-1][1]

    monkeypatch.setattr(negatives, "materialize", kept)
    negatives.hard_negatives(frame(spark, [(i, [float(i % 71), float(i)], i % 3) for i in range(400)]).coalesce(1))
    trees = dict(written)["trees"]
    groups = [g.num_rows for f in ds.dataset([x.removeprefix("file://") for x in trees.inputFiles()]).get_fragments() for g in f.row_groups]
    assert sum(groups) == 40 and max(groups) <= 16


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(12, 6))[rng.integers(0, 12, 400)] * 200 + rng.normal(size=(400, 6)) * 20).astype(np.int64)
    order, nodes, radii = negatives.build_tree(points, leaf=4)
    assert sorted(order.tolist()) == list(range(400)) and len(nodes) > 12
    x = points[order].astype(float)
    square = (x * x).sum(axis=1)
    x = np.column_stack([x, np.sqrt(square.max() - square)])
    apart = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(axis=-1))

    def below(node):
        centre, start, end, first, last = nodes[node]
        return list(range(start, end)) + [p for child in range(first, last) for p in below(child)]

    for node, (centre, start, end, first, last) in enumerate(nodes):
        points_below = below(node)
        assert centre in points_below
        assert apart(points_below, centre).max() <= radii[node]  # covering
        for a in range(first, last):
            assert radii[a] <= radii[node] / 2 + 1e-6 * radii[0]
            for b in range(a):
                if b >= first:
                    assert apart(nodes[a][0], nodes[b][0]) > radii[node] / 2 * (1 - 1e-6)  # separation


def test_best_first_descent_skips_nodes():
    """Most points of well-separated clusters are never verified."""
    rng = np.random.default_rng(6)
    points = np.floor(rng.normal(size=(20, 8))[np.repeat(np.arange(20), 100)] * 2000 + rng.normal(size=(2000, 8)) * 20).astype(np.int64)
    order, nodes, radii = negatives.build_tree(points)
    points = points[order]
    tree = negatives.Tree(8, points.astype("<i4").tobytes(), np.zeros(2000, "<i8").tobytes(), np.arange(2000).astype("<i8").tobytes(),
                          np.arange(1, 2001).astype("<i8").tobytes(), nodes.astype("<i8").tobytes(), radii.astype("<f8").tobytes())
    verified = 0
    for a in range(0, 2000, 40):
        q = points[a].astype(float)
        best = negatives.Best(5, negatives.NO_LOW, negatives.NO_HIGH)
        verified += tree.search(q, negatives.exact_products(q[None], tree.front_points)[0], 0, a, True, [best])
        scores = points @ points[a]
        assert best.rows == sorted((-int(s), i) for i, s in enumerate(scores.tolist()) if i != a)[:5]
    assert verified < 0.25 * 50 * 2000


@pytest.mark.parametrize("name", ["op11_ns_bounds_clusters", "op12_cover_tree_negatives"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    rows = want.fetchall()
    assert rows and ran(got) == in_order(rows)
