"""Customer analytics: revenue, quartile segments, metrics, upsell lists, 360 view, badges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import badge
from shelfwise.operators.ranking import global_rank_table, with_percent_ranks, written

CUSTOMER_ATTRS = ["FirstName", "LastName", "Gender", "HouseOwnerFlag", "NumberCarsOwned",
                  "CommuteDistance", "YearlyIncome"]


# tasks that one product name's customers are dealt over
NAME_SALT = 16


def customer_revenue(sales: DataFrame, amount_col: str = "SalesAmount") -> DataFrame:
    """(customerkey, rev) = sum(SalesAmount) per customer (also accepts the order
    summary with ``amount_col="a"``: the same sum, one level up)."""
    return sales.groupBy(F.col("CustomerKey").alias("customerkey")) \
                .agg(F.sum(amount_col).cast("double").alias("rev"))


def model_scores(spend: DataFrame, purchase: DataFrame | None, rev: DataFrame | None,
                 score: DataFrame) -> DataFrame:
    """C17: spend LEFT JOIN purchase, revenue, propensity score on customerkey (spend drives).

    ``purchase`` / ``rev`` may be None when ``spend`` already carries those columns
    (computed in the same aggregate), which saves a join and a scan each.
    """
    out = spend
    if purchase is not None:
        out = out.join(purchase.select("customerkey", "purchase_prob"), "customerkey", "left")
    if rev is not None:
        out = out.join(rev.select("customerkey", "rev"), "customerkey", "left")
    out = out.join(score.select("customerkey", "score"), "customerkey", "left")
    return out.select("customerkey", "spend", "purchase_prob", "rev", "score")


# percent_rank quartile edges.
QUARTILE_EDGES = (0.25, 0.50, 0.75)


def _quartile(pr) -> F.Column:
    q1, q2, q3 = QUARTILE_EDGES
    return F.when(pr <= q1, 1).when(pr <= q2, 2).when(pr <= q3, 3).otherwise(4)


def customer_ranks(scores: DataFrame) -> DataFrame:
    """C18+C19 together: score quartiles (NULL -> 0 -> quartile 0) and spend / purchase
    probability quartiles, all tie-broken by revenue. The scored input is materialised
    once and the three exact global ranks are computed from it side by side."""
    t = scores.schema["score"].dataType
    base = scores.withColumn("score", F.coalesce(F.col("score"), F.lit(0).cast(t)))
    specs = [([(c, True), ("rev", True)], f"{c}_rank") for c in ("score", "spend", "purchase_prob")]
    out = with_percent_ranks(base, specs)
    return out.select(
        *scores.columns, "score_rank",
        F.when(F.col("score") == 0, 0).otherwise(_quartile(F.col("score_rank"))).alias("score_quartile"),
        "spend_rank", _quartile(F.col("spend_rank")).alias("spend_quartile"),
        "purchase_prob_rank", _quartile(F.col("purchase_prob_rank")).alias("purchase_prob_quartile"))


def order_summary(sales: DataFrame) -> DataFrame:
    """Per (customer, order): units, amounts, their non-null counts, order date range, lines.

    The first aggregation level of every per-customer dataset (``customer_summary`` is the second).
    """
    return sales.groupBy("CustomerKey", "SalesOrderNumber").agg(
        F.sum("OrderQuantity").alias("u"), F.count("OrderQuantity").alias("nu"),
        F.sum("SalesAmount").alias("a"), F.count("SalesAmount").alias("na"),
        F.min("OrderDate").alias("d0"), F.max("OrderDate").alias("d1"), F.count(F.lit(1)).alias("lines"))


def customer_summary(orders: DataFrame, spend_from: dt.date | None = None) -> DataFrame:
    """Per customer, from the order summary: all that metrics, averages, revenue and score inputs need.

    ``TotalOrders`` counts distinct orders, so a missing order number is none; ``spend`` sums the
    orders after ``spend_from`` (all, without it).
    """
    recent = F.col("a") if spend_from is None else F.when(F.col("d1") > F.lit(spend_from), F.col("a"))
    return orders.groupBy("CustomerKey").agg(
        F.count("SalesOrderNumber").alias("TotalOrders"),
        F.sum("u").alias("TotalUnitsOrdered"), F.sum("nu").alias("__nu"),
        F.sum("a").alias("__amt"), F.sum("na").alias("__na"), F.sum(recent).alias("__recent"),
        F.max("d1").alias("LatestOrderDate"), F.min("d0").alias("EarliestOrderDate"))


def population_averages(summary: DataFrame) -> DataFrame:
    """C20: one row: average per-customer order count, units and sales amount (customers without a value left out)."""
    def average(column: str) -> F.Column:
        return F.sum(column).cast("double") / F.count(column)

    return summary.agg(average("TotalOrders").alias("AvgTotalOrders"),
                       average("TotalUnitsOrdered").alias("AvgTotalUnitsOrdered"),
                       average("__amt").alias("AvgTotalSalesAmount"))


def customer_metrics(summary: DataFrame, customers: DataFrame) -> DataFrame:
    """Per-customer order metrics + population averages (rounded to 1 dp) + attributes.

    ``summary`` (``customer_summary``) is read twice, so pass a materialised one: the fact is then
    scanned once. The customer attributes join the per-customer rows; the one-row
    population average is attached with a broadcast cross join.
    """
    attrs = customers.select("CustomerKey", *CUSTOMER_ATTRS)
    j = summary.join(attrs, "CustomerKey", "left").crossJoin(F.broadcast(population_averages(summary)))
    return j.select(
        "CustomerKey", "TotalOrders", "TotalUnitsOrdered",
        F.try_divide(F.col("TotalUnitsOrdered").cast("double"), F.col("__nu")).alias("AvgUnitsOrdered"),
        F.col("__amt").cast("double").alias("TotalSalesAmount"),
        F.try_divide(F.col("__amt").cast("double"), F.col("__na")).alias("AvgSalesAmount"),
        F.round("AvgTotalOrders", 1).alias("POP_AvgTotalOrders"),
        F.round("AvgTotalUnitsOrdered", 1).alias("POP_AvgTotalUnitsOrdered"),
        F.round("AvgTotalSalesAmount", 1).alias("POP_AvgTotalSalesAmount"),
        "LatestOrderDate", "EarliestOrderDate", *CUSTOMER_ATTRS)


def customer_upsells(sales_view: DataFrame, upsells: DataFrame) -> DataFrame:
    """(customerkey, upsell_list) — distinct first upsell of every anchor product bought.

    Joined on product *name*, and names map to many keys, so a name may have any number of upsells. Upsells are numbered
    in their order, and 64 of them are one row: a word number and its bits. A line meets a name's words, not its upsells,
    and a customer's words are united by ``bit_or``, which combines before the shuffle and takes repeated lines as one.
    The list is sorted for determinism and bounded by the number of distinct upsell names.
    """
    u = upsells.select(F.col("bike_name").alias("EnglishProductName"), F.col("upsell_1").alias("upsell")) \
               .distinct()
    u = written(u, "upsells")
    numbers = global_rank_table(u.where(F.col("upsell").isNotNull()).select("upsell").distinct(), [("upsell", False)])
    numbers = written(numbers.select("upsell", F.expr("cast((rank - 1) div 64 as int)").alias("word"),
                                     F.expr("cast((rank - 1) % 64 as int)").alias("bit")), "upsell_numbers")
    # a missing upsell has no bit, but its customers still get a list
    bits = F.expr("coalesce(shiftleft(1L, bit), 0L)")
    masks = u.join(numbers, "upsell", "left").groupBy("EnglishProductName", F.coalesce("word", F.lit(0)).alias("word")).agg(F.bit_or(bits).alias("bits"))
    words = numbers.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("bit", "upsell"))).alias("names"))
    masks, words = written(masks, "upsell_masks"), written(words, "upsell_words")
    # few names, many customers: a name's customers are dealt over ``NAME_SALT`` tasks and its words copied to each
    salt = F.pmod(F.xxhash64("customerkey"), F.lit(NAME_SALT)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(NAME_SALT - 1))).alias("salt")
    s = sales_view.select(F.col("CustomerKey").alias("customerkey"), "EnglishProductName").select("*", salt)
    j = s.join(masks.select("*", copies), ["EnglishProductName", "salt"]).groupBy("customerkey", "word").agg(F.bit_or("bits").alias("bits"))
    named = j.select("*", salt).join(words.select("*", copies), ["word", "salt"], "left")
    own = F.transform(F.filter("names", lambda n: F.getbit("bits", n["bit"]) == 1), lambda n: n["upsell"])
    lists = named.select("customerkey", F.coalesce(own, F.array().cast("array<string>")).alias("own"))
    return lists.groupBy("customerkey").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("upsell_list"))


def customer_360(metrics: DataFrame, ranks: DataFrame, upsell_lists: DataFrame) -> DataFrame:
    """Metrics LEFT JOIN ranks LEFT JOIN upsell lists -> the 21-column customer table."""
    r = ranks.select(F.col("customerkey").alias("__ck"), F.col("rev").alias("Lifetime_Spend"),
                     F.col("spend_quartile").alias("future_spend_prediction_quartile"),
                     F.col("purchase_prob_quartile").alias("future_purchase_prob_quartile"),
                     F.col("score_quartile").alias("bike_upsell_score_quartile"))
    u = upsell_lists.select(F.col("customerkey").alias("__uk"), "upsell_list")
    j = (metrics.join(r, metrics.CustomerKey == r["__ck"], "left")
                .join(u, metrics.CustomerKey == u["__uk"], "left"))
    return j.select(
        "CustomerKey", "FirstName", "LastName", "TotalOrders", "TotalUnitsOrdered", "TotalSalesAmount",
        "POP_AvgTotalOrders", "POP_AvgTotalUnitsOrdered", "POP_AvgTotalSalesAmount",
        "LatestOrderDate", "EarliestOrderDate", "Gender", "HouseOwnerFlag", "NumberCarsOwned",
        "CommuteDistance", "YearlyIncome", "Lifetime_Spend", "future_spend_prediction_quartile",
        "future_purchase_prob_quartile", "bike_upsell_score_quartile", "upsell_list")


def badges(details: DataFrame) -> DataFrame:
    """Gold / Silver / Bronze for every customer in one pass."""
    return details.select(
        "CustomerKey", "future_spend_prediction_quartile", "future_purchase_prob_quartile",
        badge("future_spend_prediction_quartile", "future_purchase_prob_quartile").alias("badge")).distinct()
