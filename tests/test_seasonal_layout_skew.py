"""Seasonal ridge forecast against dense least squares, interleaved layout by file statistics, joins of hot keys."""

import datetime as dt
import glob
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shelfwise.functions.layout import interleaved_key
from shelfwise.functions.skew import join_split
from shelfwise.operators import basket, seasonal, text
from shelfwise.sources import ingest

SALES = "ProductKey bigint, OrderDate date, OrderQuantity bigint"
EPOCH = dt.date(1970, 1, 1)


def test_forecast_equals_dense_ridge(spark):
    rng = random.Random(5)
    start, days = dt.date(1996, 3, 1), 900
    rows = []
    for product in range(1, 6):
        first = rng.randrange(days - 1) if product < 5 else days - 1
        rows += [(product, start + dt.timedelta(first), 3)]
        rows += [(product, start + dt.timedelta(rng.randrange(first, days)), rng.randint(1, 9 * product)) for _ in range(300)]
    rows += [(1, start + dt.timedelta(days - 1), 2), (1, None, 7), (None, start, 7), (2, start + dt.timedelta(days - 1), None)]
    sales = spark.createDataFrame(rows, SALES)
    got = {}
    for r in seasonal.seasonal_forecast(sales, horizon=40).collect():
        got[r.ProductKey, (r.ds - EPOCH).days] = r.yhat
    good = [r for r in rows if None not in r]
    first_day, last_day = (f((r[1] - EPOCH).days for r in good) for f in (min, max))
    basis = seasonal.Basis(first_day, last_day)
    expected = {}
    for product in range(1, 6):
        mine = [((r[1] - EPOCH).days, r[2]) for r in good if r[0] == product]
        span = np.arange(min(d for d, _ in mine), last_day + 1)
        y = np.zeros(len(span))
        for d, q in mine:
            y[d - span[0]] += q
        # ridge as plain least squares with one more row per penalised coefficient
        x = basis.matrix(span) / basis.scale()
        extra = np.eye(basis.size())[1:] * seasonal.PENALTY ** 0.5
        beta = np.linalg.lstsq(np.concatenate([x, extra]), np.concatenate([y, np.zeros(len(extra))]), rcond=None)[0]
        ahead = np.arange(last_day + 1, last_day + 41)
        for d, v in zip(ahead.tolist(), basis.matrix(ahead) / basis.scale() @ beta):
            expected[product, d] = max(v, 0.0)
    assert set(got) == set(expected)
    wrong = {k: (got[k], expected[k]) for k in got if abs(got[k] - expected[k]) > 0.5 + 1e-5}
    assert not wrong
    sides = seasonal.seasonal_equations(sales).collect()
    assert len(sides) == 5 * basis.size() and all(abs(r.observed - r.fitted) <= 0.002 for r in sides)
    assert seasonal.seasonal_forecast(sales.where("false")).count() == 0


def test_forecast_follows_the_year(spark):
    start = dt.date(1995, 1, 1)
    rows = [(1, start + dt.timedelta(d), round(100 + 50 * np.sin(2 * np.pi * ((start - EPOCH).days + d) / 365.25))) for d in range(4 * 365)]
    got = seasonal.seasonal_forecast(spark.createDataFrame(rows, SALES), horizon=365).collect()
    for r in got:
        assert abs(r.yhat - (100 + 50 * np.sin(2 * np.pi * (r.ds - EPOCH).days / 365.25))) < 4


def _files_opened(path: str, column: str, low: int, high: int) -> float:
    """Share of the files whose statistics do not rule the range out."""
    opened = []
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(name)
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        opened.append(any(s.min <= high and s.max >= low for s in stats))
    return sum(opened) / len(opened)


def test_interleaved_layout_serves_both_keys(spark, tmp_path):
    # every fourth row has the same first key
    df = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("a"),
                                    F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)).alias("b"), "id")
    paths = {kind: str(tmp_path / kind) for kind in ("plain", "interleaved")}
    for kind, path in paths.items():
        ingest.write_clustered(df, ["a", "b"], path, num_partitions=64, interleaved=kind == "interleaved")
        assert spark.read.parquet(path).exceptAll(df).isEmpty() and spark.read.parquet(path).count() == 40_000
    assert _files_opened(paths["plain"], "b", 5000, 5200) > 0.6
    assert _files_opened(paths["interleaved"], "b", 5000, 5200) < 0.35
    assert _files_opened(paths["interleaved"], "a", 5000, 5200) < 0.35
    sizes = [pq.read_metadata(n).num_rows for n in glob.glob(f"{paths['interleaved']}/*.parquet")]
    assert max(sizes) < 4 * np.median(sizes)


def test_interleaved_key_of_all_kinds_and_nulls(spark):
    rows = [(i, None if i % 5 == 0 else f"w{i:03}", dt.date(2000, 1, 1) + dt.timedelta(i), i / 7, dt.datetime(2001, 1, 1) + dt.timedelta(hours=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "n int, s string, d date, f double, t timestamp")
    for one in ("n", "s", "d", "f", "t"):
        keys = [r.k for r in df.where(F.col(one).isNotNull()).select(one, interleaved_key(df, [one]).alias("k")).orderBy(one).collect()]
        assert keys == sorted(keys) and len(set(keys)) > 30
    assert df.select(interleaved_key(df, ["n", "s", "d"]).alias("k")).where("k IS NULL OR k < 0 OR k >= 1 << 18").isEmpty()
    empty = df.where("false")
    assert empty.select(interleaved_key(empty, ["n"])).count() == 0


def _pieces(df) -> list[int]:
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_hot_keys_are_split(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("key"), "id")
        side = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        joined = join_split(rows, side, "key", "n")
        assert joined.columns == ["key", "id", "top"] and joined.count() == 60_000
        assert joined.exceptAll(rows.join(side.drop("n"), "key")).isEmpty()
        parts = _pieces(joined)
        assert max(parts) <= 4 * np.median(parts) < 4 * max(_pieces(rows.join(side.drop("n"), "key")))
        kept = join_split(rows, side, "key", "n", wanted=F.col("key") != -1)
        assert kept.count() == 40_000 and kept.where("key = -1").isEmpty()
        assert join_split(rows.where("false"), side.where("false"), "key", "n").count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pairs_and_keywords_with_hot_keys(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 == 0 else f"t{rng.randrange(200)}", rng.randrange(40), rng.choice(["A", "B", "C"])) for i in range(3000)]
    rows += [("noanchor", k, "B") for k in range(900)]
    df = spark.createDataFrame(rows, "transaction_id string, productkey int, category string")
    got = {(r.bike_key, r.product_key, r.product_category): r["count"] for r in basket.pair_counts(df, "A", 50).collect()}
    by, expected = {}, {}
    for t, p, c in rows:
        by.setdefault(t, []).append((p, c))
    for lines in by.values():
        for a in (p for p, c in lines if c == "A"):
            for p, c in lines:
                if c != "A":
                    expected[a, p, c] = expected.get((a, p, c), 0) + 1
    assert got == expected
    docs = spark.createDataFrame([(i, "common " * (i % 3 + 1) + f"rare{'abcdefghij'[i % 10]}x") for i in range(300)], "id int, text string")
    words = {r.id: r.refined_description for r in text.keywords(docs, "id", "text", 2).collect()}
    assert len(words) == 300 and all(w.split(", ") == [f"rare{'abcdefghij'[i % 10]}x", "common"] for i, w in words.items())
