"""Margins, demand ranking, reorder policy and stock status."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ranking import with_row_number
from shelfwise.sources.ingest import publish_clustered
from shelfwise.sources.publish import read_published

# Reorder policy parameters (top 20% by demand get 15% safety stock,
# the rest demand + 1 unit).
TOP_SHARE = 0.2
SAFETY = 1.15
FLOOR_UNITS = 1


def margin(sales: DataFrame) -> DataFrame:
    """I8: (ProductKey, Margin_Pct) = round(sum(Profit) / sum(SalesAmount), 2); NULL when sales sum is 0."""
    g = sales.groupBy("ProductKey").agg(F.sum("Profit").cast("double").alias("p"),
                                        F.sum("SalesAmount").cast("double").alias("s"))
    return g.select("ProductKey", F.round(F.try_divide(F.col("p"), F.col("s")), 2).alias("Margin_Pct"))


def demand(stock: DataFrame, weekly: DataFrame, weeks: int = 4) -> DataFrame:
    """Stock position INNER JOIN weekly forecast; TotalForecastedDemand = sum of the weeks."""
    w = [f"Week{i}Demand" for i in range(1, weeks + 1)]
    total = F.col(w[0])
    for c in w[1:]:
        total = total + F.col(c)
    j = stock.select("ProductKey", "UnitsBalance", "LeadTimeWeeks").join(weekly, "ProductKey", "inner")
    return j.select("ProductKey", "UnitsBalance", "LeadTimeWeeks", *w, total.alias("TotalForecastedDemand"))


def rank_demand(dem: DataFrame) -> DataFrame:
    """Rank = row_number() over (TotalForecastedDemand desc, ProductKey) and TotalCount,
    computed without a single-partition window (see ranking)."""
    return with_row_number(dem, [("TotalForecastedDemand", True), ("ProductKey", False)], "Rank",
                           count_col="TotalCount")


def reorder_policy(ranked: DataFrame, top_share: float = TOP_SHARE, safety: float = SAFETY,
                   floor_units: int = FLOOR_UNITS, weeks: int = 4) -> DataFrame:
    """OrderQuantity = greatest(top ? ceil(demand*safety) - balance : demand + floor - balance, 0)."""
    d, bal = F.col("TotalForecastedDemand"), F.col("UnitsBalance")
    top = F.col("Rank") <= F.col("TotalCount") * F.lit(Decimal(str(top_share)))
    qty = F.when(top, (F.ceil(d * F.lit(float(safety))) - bal).cast("double")) \
           .otherwise(d + F.lit(floor_units) - bal)
    return ranked.select("ProductKey", "UnitsBalance", "LeadTimeWeeks",
                         *[f"Week{i}Demand" for i in range(1, weeks + 1)], "TotalForecastedDemand",
                         F.greatest(qty, F.lit(0.0)).alias("OrderQuantity"))


def inventory_status(policy: DataFrame, margins: DataFrame) -> DataFrame:
    """Stock flags + margin (LEFT JOIN) -> product_inventory_status."""
    bal = F.col("UnitsBalance")
    j = policy.join(margins, "ProductKey", "left")
    return j.select(*policy.columns,
                    F.when(bal > 0, 1).otherwise(0).alias("HasStock"),
                    F.when(F.col("OrderQuantity") > 0, 1).otherwise(0).alias("NeedsOrder"),
                    F.when(bal > 0, 0).otherwise(F.col("LeadTimeWeeks")).alias("WeeksUntilStockAvailable"),
                    "Margin_Pct")


def publish_status(status: DataFrame, root: str) -> DataFrame:
    """I12 as a stored table: publish a new version clustered by product (one atomic step, ``sources.publish``) and read it."""
    publish_clustered(status, ["ProductKey"], root)
    return read_published(status.sparkSession, root)


def distinct_descriptions(products: DataFrame) -> DataFrame:
    """Distinct product descriptions."""
    return products.select("EnglishDescription").distinct()
