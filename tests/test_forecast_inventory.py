import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from shelfwise.operators import forecast, inventory
from shelfwise.plans import catalog as C

D = dt.date


def _sales(spark, lines):
    return spark.createDataFrame(lines, "ProductKey long, OrderDate date, OrderQuantity int")


FIXTURE = [
    (1, D(2001, 7, 1), 3), (1, D(2001, 7, 1), 2), (1, D(2001, 7, 4), 7), (1, D(2001, 7, 20), 1),
    (1, D(2001, 7, 30), 4), (1, D(2001, 8, 1), 2),
    (2, D(2001, 8, 1), 5),                                    # sold once, on the last day
    (3, D(2001, 6, 2), 1), (3, D(2001, 6, 3), 9), (3, D(2001, 6, 10), 2),  # gap days
]


def _brute(lines, horizon=28):
    last = max(d for _, d, _ in lines)
    out = {}
    for p in sorted({p for p, _, _ in lines}):
        first = min(d for q, d, _ in lines if q == p)
        n = (last - first).days + 1
        y = np.zeros(n)
        for q, d, v in lines:
            if q == p:
                y[(d - first).days] += v
        t = np.arange(n, dtype=float)
        if n > 1:
            b, a = np.polyfit(t, y, 1)
        else:
            b, a = 0.0, y.mean()
        resid = y - (a + b * t)
        eff = [resid[t % 7 == r].mean() if (t % 7 == r).any() else 0.0 for r in range(7)]
        for h in range(1, horizon + 1):
            tt = n - 1 + h
            out[(p, last + dt.timedelta(days=h))] = float(np.round(max(a + b * tt + eff[tt % 7], 0.0)))
    return out


def test_forecast_closed_form_matches_dense_least_squares(spark):
    got = {(r["ProductKey"], r["ds"]): r["yhat"] for r in rows(forecast.forecast_demand(_sales(spark, FIXTURE)))}
    want = _brute(FIXTURE)
    assert got.keys() == want.keys()
    assert got == want


def test_fit_params_product_sold_once(spark):
    p = {r["ProductKey"]: r for r in rows(forecast.fit_params(_sales(spark, FIXTURE)))}
    assert p[2]["n"] == 1 and p[2]["b"] == 0.0 and p[2]["a"] == 5.0


def test_daily_demand_dense_and_stats(spark):
    dense = rows(forecast.daily_demand(_sales(spark, FIXTURE)), "ProductKey", "ds")
    by = {}
    for r in dense:
        by.setdefault(r["ProductKey"], []).append(r)
    assert len(by[1]) == 32 and by[1][0]["y"] == 5 and by[1][1]["y"] == 0
    assert len(by[2]) == 1 and by[2][0]["y"] == 5
    assert len(by[3]) == (D(2001, 8, 1) - D(2001, 6, 2)).days + 1
    # every day exactly once per product
    assert len({(r["ProductKey"], r["ds"]) for r in dense}) == len(dense)
    st = {r["ProductKey"]: r for r in rows(forecast.grid_stats(forecast.daily_demand(_sales(spark, FIXTURE))))}
    assert st[1]["total"] == 19 and st[1]["zero_days"] == 32 - 5


def test_weekly_buckets_midweek_and_new_year(spark):
    # horizon starting mid-week and crossing New Year: slots keep calendar order
    start = D(2001, 12, 27)  # Thursday
    fc = spark.createDataFrame([(7, start + dt.timedelta(days=i), 1.0) for i in range(28)],
                               "ProductKey long, ds date, yhat double")
    w = rows(forecast.weekly_buckets(fc))[0]
    assert (w["Week1Demand"], w["Week2Demand"], w["Week3Demand"], w["Week4Demand"]) == (4.0, 7.0, 7.0, 7.0)
    monday = spark.createDataFrame([(8, D(2001, 7, 30) + dt.timedelta(days=i), 2.0) for i in range(28)],
                                   "ProductKey long, ds date, yhat double")
    w = rows(forecast.weekly_buckets(monday))[0]
    assert (w["Week1Demand"], w["Week4Demand"]) == (14.0, 14.0)


def test_reorder_policy_cases(spark):
    dem = spark.createDataFrame(
        [(1, -5, 2, 10.0, 10.0, 10.0, 10.0, 40.0),   # top 20%, negative balance
         (2, 100, 1, 1.0, 1.0, 1.0, 1.0, 4.0),       # balance above demand -> 0
         (3, 0, 3, 5.0, 5.0, 5.0, 5.0, 20.0),
         (4, 3, 1, 2.0, 2.0, 2.0, 2.0, 8.0),
         (5, 1, 2, 5.0, 5.0, 5.0, 5.0, 20.0)],       # ties product 3 on demand; key breaks the tie
        "ProductKey long, UnitsBalance int, LeadTimeWeeks int, Week1Demand double, Week2Demand double, "
        "Week3Demand double, Week4Demand double, TotalForecastedDemand double")
    ranked = {r["ProductKey"]: r for r in rows(inventory.rank_demand(dem))}
    assert [ranked[k]["Rank"] for k in (1, 3, 5, 4, 2)] == [1, 2, 3, 4, 5]
    assert {r["TotalCount"] for r in ranked.values()} == {5}
    pol = {r["ProductKey"]: r["OrderQuantity"] for r in rows(inventory.reorder_policy(inventory.rank_demand(dem)))}
    assert pol[1] == 46.0 + 5        # ceil(40 * 1.15) - (-5)
    assert pol[2] == 0.0             # greatest(..., 0)
    assert pol[3] == 21.0            # rank 2 > 5 * 0.2: demand + 1 - 0
    assert pol[5] == 20.0
    margins = spark.createDataFrame([(1, 0.25)], "ProductKey long, Margin_Pct double")
    st = {r["ProductKey"]: r for r in rows(inventory.inventory_status(inventory.reorder_policy(
        inventory.rank_demand(dem)), margins))}
    assert st[1]["HasStock"] == 0 and st[1]["WeeksUntilStockAvailable"] == 2 and st[1]["NeedsOrder"] == 1
    assert st[2]["HasStock"] == 1 and st[2]["NeedsOrder"] == 0 and st[2]["Margin_Pct"] is None


def test_margin_zero_sales_is_null(spark):
    s = spark.createDataFrame([(1, "0.0000", "0.0000"), (2, "10.0000", "40.0000"), (2, "5.0000", "10.0000")],
                              "ProductKey long, Profit string, SalesAmount string")
    s = s.select("ProductKey", F.col("Profit").cast("decimal(18,4)").alias("Profit"),
                 F.col("SalesAmount").cast("decimal(18,4)").alias("SalesAmount"))
    got = {r["ProductKey"]: r["Margin_Pct"] for r in rows(inventory.margin(s))}
    assert got == {1: None, 2: 0.3}


def test_sums_of_products_serve_forecast_and_margin(spark):
    """The order lines are joined and summed once; null and repeated keys, days and quantities count as in the lines."""
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    sold = [(p, day(n * n % 40), n % 5, Decimal(n), Decimal(2 * n + 1)) for p in (1, 2, 3, None) for n in range(12)]
    sold += [(4, None, 3, Decimal(1), None), (4, day(2), None, None, Decimal(0)), (5, day(1), 2, Decimal(1), Decimal(0))] + sold[:5]
    s = spark.createDataFrame(sold, "ProductKey long, OrderDate date, OrderQuantity int, Profit decimal(18,4), SalesAmount decimal(18,4)")
    sums = forecast.product_sums(s, also=("Profit", "SalesAmount"))
    by_key = lambda df: {r["ProductKey"]: r for r in rows(df)}
    got, units = by_key(sums), {}
    for p, d, q, *_ in sold:
        k = (d - dt.date(1970, 1, 1)).days % 7 if d else None
        units.setdefault(p, [0] * 7)
        for i in range(7):
            units[p][i] += (q or 0) if i == k else 0
    assert {p: [r[f"Sk{k}"] or 0 for k in range(7)] for p, r in got.items()} == units
    assert {p: r["Sy"] for p, r in got.items()} == {p: sum(x[2] or 0 for x in sold if x[0] == p) for p in units}
    assert by_key(inventory.margin(sums)) == by_key(inventory.margin(s))
    assert by_key(forecast.fit_params(s, sums=sums)) == by_key(forecast.fit_params(s))


def test_status_scans_the_order_lines_once_for_forecast_and_margin(spark):
    plan = C.q_inventory_status(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan  # the margin's sums are those that the forecast has made
