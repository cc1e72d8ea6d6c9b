import itertools
from collections import Counter

from conftest import rows
from shelfwise.operators import basket, customer
from shelfwise.functions.columns import badge
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_quartiles_edges_ties_nulls(spark):
    # 9 customers, one null spend (sorts last on desc), ties broken by rev only
    data = [(1, 100.0, 10.0), (2, 90.0, 9.0), (3, 90.0, 8.0), (4, 80.0, 7.0), (5, 70.0, 6.0),
            (6, 60.0, 5.0), (7, 50.0, 4.0), (8, 40.0, 3.0), (9, None, 2.0)]
    df = spark.createDataFrame(data, "customerkey int, spend double, rev double")
    out = {r["customerkey"]: (r["spend_rank"], r["spend_quartile"])
           for r in rows(customer.customer_ranks(df.selectExpr("*", "1.0D AS purchase_prob", "0.5D AS score")))}
    # percent_rank = (rank-1)/(n-1) with n = 9: exact .25/.5/.75 at ranks 3, 5, 7
    assert out[1] == (0.0, 1) and out[3] == (0.25, 1) and out[4] == (0.375, 2)
    assert out[5] == (0.5, 2) and out[7] == (0.75, 3) and out[8] == (0.875, 4)
    assert out[9] == (1.0, 4)


def test_score_quartiles_zero_and_null_get_quartile_zero(spark):
    data = [(1, 0.9, 5.0), (2, None, 4.0), (3, 0.0, 3.0), (4, 0.5, 2.0), (5, 0.1, 1.0)]
    df = spark.createDataFrame(data, "customerkey int, score double, rev double")
    got = {r["customerkey"]: r["score_quartile"] for r in rows(customer.customer_ranks(df.selectExpr("*", "1.0D AS spend", "1.0D AS purchase_prob")))}
    assert got[2] == 0 and got[3] == 0
    # ranks over all 5 rows: 0, .25, .5 for the non-zero scores
    assert got[1] == 1 and got[4] == 1 and got[5] == 2


def test_customer_ranks_equal_global_windows(spark):
    data = [(i, float(i % 7), (i * 3) % 5 / 10.0 if i % 4 else None, float(i % 3), (i % 5) / 10.0 or None)
            for i in range(40)]
    df = spark.createDataFrame(data, "customerkey int, spend double, purchase_prob double, rev double, score double")
    together = {r["customerkey"]: r for r in rows(customer.customer_ranks(df))}
    step = df.fillna(0.0, ["score"])
    for c in ("score", "spend", "purchase_prob"):
        over = Window.orderBy(F.col(c).desc_nulls_last(), F.col("rev").desc_nulls_last())
        step = step.withColumn(f"{c}_rank", F.percent_rank().over(over))
    for r in rows(step):
        t = together[r["customerkey"]]
        for c in ("score", "spend", "purchase_prob"):
            assert t[f"{c}_rank"] == r[f"{c}_rank"]
            quartile = 1 + sum(r[f"{c}_rank"] > edge for edge in (0.25, 0.5, 0.75))
            assert t[f"{c}_quartile"] == (0 if c == "score" and r[c] == 0 else quartile)


def test_customer_metrics_repeated_order_lines_and_population(spark):
    sales = spark.createDataFrame(
        [(1, 100, 2, "10.0000", "2001-01-01"), (1, 100, 3, "20.0000", "2001-01-01"),
         (1, 101, 1, "5.0000", "2001-02-01"), (2, 200, 4, "40.0000", "2000-05-05")],
        "CustomerKey long, SalesOrderNumber long, OrderQuantity int, SalesAmount string, OrderDate string"
    ).withColumn("SalesAmount", F.col("SalesAmount").cast("decimal(18,4)")) \
     .withColumn("OrderDate", F.to_date("OrderDate"))
    cust = spark.createDataFrame([(1, "A", "B", None, "1", 2, "0-1 Miles", 50000.0)],
                                 "CustomerKey long, FirstName string, LastName string, Gender string, "
                                 "HouseOwnerFlag string, NumberCarsOwned int, CommuteDistance string, "
                                 "YearlyIncome double")
    got = {r["CustomerKey"]: r for r in rows(customer.customer_metrics(customer.customer_summary(customer.order_summary(sales)), cust))}
    a = got[1]
    assert a["TotalOrders"] == 2 and a["TotalUnitsOrdered"] == 6 and a["AvgUnitsOrdered"] == 2.0
    assert a["TotalSalesAmount"] == 35.0 and abs(a["AvgSalesAmount"] - 35.0 / 3) < 1e-12
    assert a["POP_AvgTotalOrders"] == 1.5 and a["POP_AvgTotalUnitsOrdered"] == 5.0
    assert a["POP_AvgTotalSalesAmount"] == 37.5 and a["Gender"] is None
    assert got[2]["FirstName"] is None  # customer missing from the dimension keeps its metrics



def test_badge_rules(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 1, 4), (4, None, 1), (5, 0, 0)], "k int, s int, p int")
    got = {r["k"]: r["b"] for r in rows(df.select("k", badge("s", "p").alias("b")))}
    assert got == {1: "Gold", 2: "Bronze", 3: "Silver", 4: "Silver", 5: "Silver"}


def _brute_pairs(lines, anchor):
    by_t = {}
    for t, p, c in lines:
        by_t.setdefault(t, []).append((p, c))
    cnt = Counter()
    for items in by_t.values():
        for (bp, bc), (pp, pc) in itertools.product(items, items):
            if bc == anchor and pc != anchor:
                cnt[(bp, pp, pc)] += 1
    return cnt


def test_pair_counts_equal_line_level_self_join(spark):
    lines = [(1, 10, "Bikes"), (1, 10, "Bikes"), (1, 20, "Helmets"), (1, 21, "Helmets"), (1, 30, None),
             (2, 11, "Bikes"), (2, 20, "Helmets"), (2, 20, "Helmets"),
             (3, 10, "Bikes"),                     # basket with only the anchor
             (4, 20, "Helmets"), (4, 30, "Locks")]  # no anchor
    df = spark.createDataFrame(lines, "t long, p long, c string")
    br = basket.basket_rows(df, "t", "p", "c")
    want = _brute_pairs([(t, p, c if c is not None else basket.NO_CATEGORY) for t, p, c in lines], "Bikes")
    for bucket in (1, 2, 1_000_000):  # every basket cut on both sides (1, 2) or none (default)
        got = {(r["bike_key"], r["product_key"], r["product_category"]): r["count"]
               for r in rows(basket.pair_counts(br, "Bikes", pairs_per_bucket=bucket))}
        assert got == dict(want), bucket
        assert got[(10, 20, "Helmets")] == 2 and got[(11, 20, "Helmets")] == 2


def test_pair_counts_hot_basket_salted(spark):
    # one basket holds most lines: 3 anchor items x 200 companions, plus small baskets
    lines = [(1, 10 + i, "Bikes") for i in range(3)] + [(1, 100 + i, "Parts") for i in range(200)]
    lines += [(t, 10, "Bikes") for t in range(2, 6)] + [(t, 100, "Parts") for t in range(2, 6)]
    df = spark.createDataFrame(lines, "t long, p long, c string")
    got = {(r["bike_key"], r["product_key"]): r["count"]
           for r in rows(basket.pair_counts(basket.basket_rows(df, "t", "p", "c"), "Bikes", pairs_per_bucket=20))}
    assert len(got) == 600 and got[(10, 100)] == 5 and sum(got.values()) == 600 + 4


def test_top_per_group_ties_and_lists(spark):
    counts = spark.createDataFrame(
        [(1, 100, "A", 5), (1, 101, "A", 4), (1, 102, "A", 4), (1, 103, "A", 4), (1, 104, "A", 1),
         (1, 200, "B", 9), (2, 300, "A", 1)],
        "bike_key long, product_key long, product_category string, count long")
    top = rows(basket.top_per_group(counts, 3), "bike_key", "product_key")
    assert [r["product_key"] for r in top if r["bike_key"] == 1] == [100, 101, 102, 103, 200]
    assert {r["product_key"]: r["rank"] for r in top}[103] == 2
    lists = {r["bike_key"]: r for r in rows(basket.top_lists(basket.top_per_group(counts, 3), 3))}
    assert (lists[1]["Top_Product_1"], lists[1]["Top_Product_2"], lists[1]["Top_Product_3"]) == (200, 100, 101)
    assert lists[2]["Top_Product_2"] is None  # fewer than 3 companions


def test_category_diversity_and_anchor_baskets(spark):
    lines = [(1, 10, "Bikes"), (1, 20, "Helmets"), (2, 20, "Helmets"), (3, 30, None)]
    br = basket.basket_rows(spark.createDataFrame(lines, "t long, p long, c string"), "t", "p", "c")
    assert {r["cats"]: r["count"] for r in rows(basket.category_diversity(br))} == {2: 1, 1: 2}
    assert sorted(r["productkey"] for r in rows(basket.anchor_baskets(br, "Bikes"))) == [10, 20]


def test_metrics_ignore_missing_order_numbers_and_amounts(spark):
    sales = spark.createDataFrame(
        [(1, None, 2, 10.0, "2001-01-01"), (1, 5, None, None, "2001-01-02"), (2, None, None, None, "2001-01-03"), (3, 7, 4, 6.0, None)],
        "CustomerKey long, SalesOrderNumber long, OrderQuantity int, SalesAmount double, OrderDate string"
    ).withColumn("SalesAmount", F.col("SalesAmount").cast("decimal(18,4)")).withColumn("OrderDate", F.to_date("OrderDate"))
    summary = customer.customer_summary(customer.order_summary(sales))
    assert {r["CustomerKey"]: r["TotalOrders"] for r in rows(summary)} == {1: 1, 2: 0, 3: 1}
    pop = rows(customer.population_averages(summary))[0]
    # customer 2 has no quantity and no amount: left out of those averages, but not of the order count
    assert abs(pop["AvgTotalOrders"] - 2 / 3) < 1e-12
    assert pop["AvgTotalUnitsOrdered"] == 3.0 and pop["AvgTotalSalesAmount"] == 8.0


def test_one_basket_with_a_third_of_the_rows_is_cut_on_both_sides(spark):
    data = [(1, f"a{i}", "Bikes") for i in range(60)] + [(1, f"c{i}", "Other") for i in range(90)]
    data += [(2 + i % 100, f"a{i % 7}", "Bikes") for i in range(150)] + [(2 + i % 100, f"c{i % 11}", "Other") for i in range(150)]
    df = spark.createDataFrame(data, "transaction_id int, productkey string, category string")
    want = Counter()
    baskets = {}
    for t, p, c in data:
        baskets.setdefault(t, []).append((p, c))
    for lines in baskets.values():
        for (p, c), (q, d) in itertools.product(lines, lines):
            if c == "Bikes" and d != "Bikes":
                want[p, q, d] += 1
    got = {(r["bike_key"], r["product_key"], r["product_category"]): r["count"] for r in rows(basket.pair_counts(df, "Bikes", pairs_per_bucket=100))}
    assert got == dict(want)


def test_one_name_with_a_third_of_the_rows_keeps_all_upsells(spark):
    sales = spark.createDataFrame([(i, "Hot" if i % 3 else f"N{i}") for i in range(300)], "CustomerKey long, EnglishProductName string")
    ups = spark.createDataFrame([("Hot", "u1"), ("Hot", "u2"), ("N3", "u3")], "bike_name string, upsell_1 string")
    got = {r["customerkey"]: r["upsell_list"] for r in rows(customer.customer_upsells(sales, ups))}
    assert got == {i: ["u1", "u2"] for i in range(300) if i % 3} | {3: ["u3"]}


def test_upsells_of_many_names_meet_lines_as_words(spark):
    """A name with 150 upsells is three rows of bits; missing upsells and names, repeated lines."""
    names = [f"u{i:03d}" for i in range(150)]
    upsells = spark.createDataFrame([("ring", u, None, None) for u in names for _ in range(2)] + [("bolt", None, None, None), ("nut", "u000", None, None), ("nut", None, None, None), (None, "x", None, None)],
                                    "bike_name string, upsell_1 string, upsell_2 string, upsell_3 string")
    lines = spark.createDataFrame([(1, "ring"), (1, "ring"), (1, "nut"), (2, "bolt"), (3, "nut"), (None, "nut"), (4, "none"), (5, None), (6, "bolt"), (6, "nut")],
                                  "CustomerKey long, EnglishProductName string")
    out = customer.customer_upsells(lines, upsells)
    got = {r.customerkey: r.upsell_list for r in out.collect()}
    assert got == {1: names, 2: [], 3: ["u000"], None: ["u000"], 6: ["u000"]}
    assert "upsell#" not in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(customerkey" in line and "upsell" in line)
