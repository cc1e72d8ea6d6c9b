"""Blocked exact search against plain numpy, recall of the index, and what the search queries read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMOKE, rows
from shelfwise.operators import inventory, similarity, text
from shelfwise.plans import catalog as C


def _plain(corpus, queries, k):
    """(query id, id, rank) by brute force: score descending, null scores last, then id."""
    def unit(x):
        if x is None or any(v is None or not np.isfinite(v) for v in x) or not np.linalg.norm(x):
            return None
        return np.array(x) / np.linalg.norm(x)

    out = []
    for qid, q in queries:
        u = unit(q)
        scored = []
        for i, x in corpus:
            v = unit(x)
            score = None if u is None or v is None or len(u) != len(v) else float(u @ v)
            scored.append((score is None, -(score or 0.0), i, score))
        out += [(qid, i, r, None if s is None else round(s, 9)) for r, (_, _, i, s) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_blocked_search_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(similarity, "CELL_QUERIES", 1)
    monkeypatch.setattr(similarity, "CELL_CORPUS", 2)
    rnd = random.Random(seed)
    vector = lambda: rnd.choice([None, [0.0, 0.0], [1.0, float("nan")], [2.0], [1.0, None]] + [[rnd.randint(-2, 2) * 1.0, rnd.gauss(0, 1)] for _ in range(9)])
    corpus = [(i, vector()) for i in range(120)]
    queries = [(f"q{i}", vector()) for i in range(15)]
    c = spark.createDataFrame(corpus, "id int, v array<double>").repartition(3)
    q = spark.createDataFrame(queries, "qid string, qv array<double>").repartition(2)
    got = rows(similarity.exact_topk(c, "id", "v", q, "qid", "qv", 7, query_block=4, corpus_block=10))
    key = lambda r: (r[0], r[2])
    assert sorted([(r["query_id"], r["id"], r["rank"], None if r["score"] is None else round(r["score"], 9)) for r in got], key=key) == sorted(
        _plain(corpus, queries, 7), key=key)
    assert rows(similarity.exact_topk(c.where("false"), "id", "v", q, "qid", "qv", 3)) == []
    assert rows(similarity.exact_topk(c, "id", "v", q.where("false"), "qid", "qv", 3)) == []


def _recall(spark, corpus, queries, k, **kw):
    exact = {(r["query_id"], r["vec_id"]) for r in rows(text.cosine_topk_many(corpus, "vec_id", "embedding", queries, "qid", "q", k))}
    near = rows(similarity.lsh_topk(corpus, "vec_id", "embedding", queries, "qid", "q", k, **kw))
    assert all(1 <= r["rank"] <= k for r in near)
    return len(exact & {(r["query_id"], r["vec_id"]) for r in near}) / len(exact)


def test_index_recall(spark):
    """Over the given embeddings (near copies among vectors of random direction) and over clustered vectors, where fewer bits suffice."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = given.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    assert _recall(spark, given, asked, 3) >= 0.9
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + 0.3 * rng.normal(size=(2000, 32))
    clustered = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    some = clustered.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    assert _recall(spark, clustered, some, 5) >= 0.95
    assert text.cosine_topk_many(clustered, "vec_id", "embedding", some, "qid", "q", 5, approximate=True).count() == 500


def test_search_plans_read_the_published_status(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = plan(C.q_cosine_topk_many(spark, SF_SMOKE))
    assert "NestedLoop" not in many and "Cartesian" not in many
    for query in (C.q_search_enriched, C.q_search_described):
        p = plan(query(spark, SF_SMOKE))
        assert "lineitem" not in p and "embeddings" not in p
        scans = [line for line in p.splitlines() if "FileScan parquet" in line]
        assert len(scans) == 2 and any("HasStock" in scan for scan in scans)
        assert all("PushedFilters: [In(" in scan for scan in scans)  # the hits' keys reach both scans


def test_published_status_is_replaced_for_later_searches(spark, tmp_path):
    root = str(tmp_path / "status")
    status = "ProductKey long, HasStock int, Margin_Pct double, WeeksUntilStockAvailable int"
    first = inventory.publish_status(spark.createDataFrame([(1, 1, 0.5, 0), (2, 0, None, 3)], status), root)
    products = spark.createDataFrame([(1, "a", "x", 1.0, "S"), (2, "b", None, None, "M")],
                                     "ProductKey long, EnglishProductName string, EnglishDescription string, Weight double, Size string")
    hits = spark.createDataFrame([(2, 0.9), (1, 0.8), (77, 0.7), (None, 0.1)], "productkey long, score double")
    got = rows(text.search_enriched(hits, products, first))
    assert [(r["Bike Name"], r["Has Stock"]) for r in got] == [("b", 0), ("a", 1), (None, None), (None, None)]
    second = inventory.publish_status(spark.createDataFrame([(1, 0, 0.1, 9)], status), root)
    assert {r["productkey"]: r["WeeksUntilStockAvailable"] for r in rows(text.search_described(hits, products, second))} == {2: None, 1: 9, 77: None, None: None}
    assert {r["productkey"]: r["HasStock"] for r in rows(text.search_described(hits, products, first))}[1] == 1  # the version it began with


def test_similarity_search_has_the_description_of_hits(spark):
    hits = spark.createDataFrame([(2, 0.5), (1, 0.9), (3, None)], "productkey long, score double")
    described = spark.createDataFrame([(1, "red, light"), (3, "")], "productkey long, refined_description string")
    assert [tuple(r.values()) for r in rows(text.similarity_search(hits, described))] == [(1, "red, light", 0.9), (2, None, 0.5), (3, "", None)]
