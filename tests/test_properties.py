"""Properties of the registered queries on the driver's smallest tables."""

from pyspark.sql import functions as F

from conftest import SF_SMOKE, rows
from shelfwise.operators import forecast, star
from shelfwise.plans import catalog as C
from shelfwise.sources.binding import bind


def test_left_star_joins_keep_fact_row_count(spark):
    w = bind(spark, SF_SMOKE)
    assert star.v_fact_internet_sales(w).count() == w.fact_internet_sales.count()
    assert star.v_fact_reseller_sales(w).count() == w.fact_reseller_sales.count()
    assert star.v_fact_survey_response(w).count() == w.fact_survey_response.count()


def test_dense_grid_has_one_row_per_product_day(spark):
    w = bind(spark, SF_SMOKE)
    s = w.fact_internet_sales
    last = s.agg(F.max("OrderDate")).first()[0]
    want = s.groupBy("ProductKey").agg(F.min("OrderDate").alias("f")) \
            .select(F.sum(F.datediff(F.lit(last), "f") + 1)).first()[0]
    dense = forecast.daily_demand(s)
    assert dense.count() == want
    assert dense.agg(F.sum("y")).first()[0] == s.agg(F.sum("OrderQuantity")).first()[0]


def test_inventory_policy_invariants(spark):
    st = rows(C.q_inventory_status(spark, SF_SMOKE))
    assert st and all(r["OrderQuantity"] >= 0 for r in st)
    assert all(r["NeedsOrder"] == (1 if r["OrderQuantity"] > 0 else 0) for r in st)
    assert all(r["WeeksUntilStockAvailable"] == (0 if r["UnitsBalance"] > 0 else r["LeadTimeWeeks"]) for r in st)
    ranks = sorted(r["ProductKey"] for r in rows(C.q_demand_rank(spark, SF_SMOKE)))
    assert len(ranks) == len(set(ranks)) == len(st)


def test_quartile_sizes_and_badges_partition_customers(spark):
    q = rows(C.q_quartiles(spark, SF_SMOKE))
    n = len(q)
    for col in ("spend_quartile", "purchase_prob_quartile"):
        sizes = [sum(1 for r in q if r[col] == k) for k in (1, 2, 3, 4)]
        assert sum(sizes) == n and all(abs(s - n / 4) <= n * 0.05 + 2 for s in sizes), (col, sizes)
    b = rows(C.q_badges(spark, SF_SMOKE))
    keys = [r["CustomerKey"] for r in b]
    assert len(keys) == len(set(keys)) == n and {r["badge"] for r in b} <= {"Gold", "Silver", "Bronze"}


def test_buyers_and_non_buyers_cover_all_sales_customers(spark):
    buy = {r["CustomerKey"] for r in rows(C.q_buyers(spark, SF_SMOKE))}
    non = {r["CustomerKey"] for r in rows(C.q_non_buyers(spark, SF_SMOKE))}
    every = {r["CustomerKey"] for r in rows(bind(spark, SF_SMOKE).fact_internet_sales.select("CustomerKey").distinct())}
    assert not (buy & non) and (buy | non) == every
