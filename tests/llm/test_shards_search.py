"""Hilbert shards and nearest neighbours against brute force."""

import zlib

import numpy as np
import pytest

from shelfwise.llm import ann, hilbert
from shelfwise.llm.common import table
from shelfwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, shard string, curve int"


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    position = hilbert.hilbert_positions(cells, bits)
    assert sorted(position.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(position)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, shards, n):
    assert len(rows) == n
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    counts = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    last = -1
    for s in sorted(by_shard):
        run = sorted(by_shard[s], key=lambda r: r.slot)
        assert [r.slot for r in run] == list(range(len(run)))
        assert run[0].curve >= last
        assert [r.curve for r in run] == sorted(r.curve for r in run)
        last = run[-1].curve


def test_shards_of_the_table(spark):
    rows = QUERIES["op9_hilbert_shards"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    check_shards(rows, 24, len(docs))
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_shards_edge_cases(spark):
    rows = [(None, None, None, None, "x", 1), (1, "", "en", "s", "x", 1), (1, "", "en", "s", "x", 1), (2, "é" * 50_000, None, "s", None, None)]
    rows += [(5, "same", "en", "s", "x", 1)] * 40
    docs = spark.createDataFrame(rows, DOCS)
    got = hilbert.hilbert_shards(docs, shards=5).collect()
    check_shards(got, 5, len(rows))
    assert {r["size"] for r in got if r.doc_id is None} == {8} and {r["size"] for r in got if r.doc_id == 2} == {100_008}
    assert hilbert.hilbert_shards(docs.where("false")).count() == 0


def brute(vectors, k):
    """Nearest of every id divisible by 100 over a list of (id, vector)."""
    out = {}
    ids = np.array([v[0] for v in vectors])
    for q, x in vectors:
        if q % 100 == 0:
            d = np.array([np.sqrt(((np.asarray(x) - np.asarray(y)) ** 2).sum()) for _, y in vectors])
            d[ids == q] = np.inf
            order = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
            out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def compare(rows, expected):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q, v in expected.items() if v}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [f[1] for f in found] == [v for v, _ in expected[q]]
        assert np.allclose([f[2] for f in found], [d for _, d in expected[q]], rtol=1e-12, atol=1e-12)


def test_search_equals_brute_force(spark):
    rows = QUERIES["op1_block_matrix_knn"](spark, "/root/testdata/sf0.01").collect()
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    compare(rows, brute(vectors, 10))


def test_search_with_copies_and_small_blocks(spark):
    rng = np.random.default_rng(2)
    base = np.round(rng.normal(size=(60, 5)), 2)
    vectors = [(i, base[i % 60].tolist() if i % 3 else base[0].tolist()) for i in range(100, 501)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(5)
    for groups in (1, 3, 64):
        got = ann.nearest(df, df.where("vec_id % 100 = 0"), query_block=2, candidate_block=3 if groups == 1 else 37, groups=groups).collect()
        compare(got, brute(vectors, 10))


def test_search_grid_grows_with_both_sides(spark):
    df = spark.range(1000).selectExpr("id AS vec_id", "array(1.0D + id, 2.0D) AS vector")
    asked = df.where("vec_id < 300")
    for query_block, candidate_block, groups, sides in ((300, 1000, 64, (1, 1)), (10, 10, 64, (4, 64)), (1, 1, 64, (38, 125)), (1, 1, 4, (38, 125))):
        row = ann.grid(asked, df, query_block, candidate_block, groups).first()
        assert (row.q_groups, row.c_groups) == sides


def test_search_of_huge_and_tiny_doubles(spark):
    vectors = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 1.0]), (3, [1.0, 2.0]), (100, [1e-200, 0.0]), (4, [4e-200, 0.0]), (200, [1.7e308, 0.0]), (5, [-1.7e308, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, df.where("vec_id % 100 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0][0] == (1, 1.0) and [v for v, _ in got[0][1:4]] == [3, 4, 100] and got[0][4] == (2, 2e200)
    assert got[100][0][0] == 4 and abs(got[100][0][1] / 3e-200 - 1) < 1e-12 and got[100][1] == (3, 5 ** 0.5)
    assert all(len(v) == 7 for v in got.values()) and got[200][-1] == (5, float("inf"))


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (1, [1.0, 2.5], "x"), (1, [1.0, 2.5], "x"), (1, [9.0, 9.0], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [1.0, None], "x"),
            (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [1.0], "x"), (None, [1.0, 2.0], "x"), (8, [], "x"), (100, [nan, 1.0], "x"), (200, [3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1, 0.5), (200, 1, 7, 2.0)]
    assert ann.nearest(df.where("false"), df).count() == 0
    assert ann.nearest(df, df.where("false")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 64)) * 10.0 ** rng.integers(-3, 4, (20, 1)), rng.normal(size=(30, 64))
    low, high = ann.tile_bounds(ann.quantise(a), ann.quantise(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert (low <= true).all() and (true <= high).all()


def test_shards_of_ids_at_both_ends_of_a_long(spark):
    ends = [-(1 << 63), -(1 << 63) + 5, -1, 0, 7, (1 << 63) - 5, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, "t", "en", "web") for i in ends] + [(None, "t", "en", "web")], "doc_id bigint, text string, lang string, source string")
    got = hilbert.hilbert_shards(docs, shards=3).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*ends, None], key=str)
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
