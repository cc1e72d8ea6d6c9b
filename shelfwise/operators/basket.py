"""Market-basket upsell mining.

Scale notes:
* Lines are first collapsed to distinct (basket, item, category) with a
  multiplicity, so repeated lines never multiply the pair join.
* The anchor x companion join is a shuffle join on (basket, bucket): a basket's
  pairs form a grid that is cut on both sides into buckets of bounded size, so
  even a basket holding a third of all lines is spread over proportionally many
  tasks. Pair counts are m_anchor * m_item per basket, summed with a partial
  (map-side) aggregate.
* Top-k per group uses rank/row_number filters that Spark plans as
  ``WindowGroupLimit`` both before and after the shuffle, so a hot group ships
  at most k rows (plus ties) per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.skew import join_split
from shelfwise.operators.ranking import materialize

# Category assigned to lines with no category, and the anchor category.
NO_CATEGORY = "Not Bike"
DEFAULT_ANCHOR = "Bikes"


def basket_rows(sales_view: DataFrame, basket_col: str = "SalesOrderNumber",
                item_col: str = "ProductKey", category_col: str = "EnglishProductCategoryName",
                default_category: str = NO_CATEGORY) -> DataFrame:
    """(transaction_id, productkey, category) with NULL category -> default."""
    return sales_view.select(
        F.col(basket_col).alias("transaction_id"),
        F.col(item_col).alias("productkey"),
        F.coalesce(F.col(category_col), F.lit(default_category)).alias("category"))


def category_diversity(rows: DataFrame) -> DataFrame:
    """Histogram of distinct categories per basket -> (cats, count)."""
    per = rows.groupBy("transaction_id").agg(F.countDistinct("category").alias("cats"))
    return per.groupBy("cats").agg(F.count(F.lit(1)).alias("count"))


def anchor_baskets(rows: DataFrame, anchor: str) -> DataFrame:
    """Every line of the baskets that contain at least one anchor-category line."""
    ids = rows.filter(F.col("category") == anchor).select("transaction_id")
    return rows.join(ids, "transaction_id", "left_semi")


def _weighted_items(rows: DataFrame) -> DataFrame:
    return rows.groupBy("transaction_id", "productkey", "category").agg(F.count(F.lit(1)).alias("m"))


# pairs of one basket that one task makes before the basket is split further
PAIRS_PER_BUCKET = 1_000_000


def pair_counts(rows: DataFrame, anchor: str, pairs_per_bucket: int = PAIRS_PER_BUCKET) -> DataFrame:
    """C4+C5: co-purchase line-pair counts per (bike_key, product_key, product_category).

    Equal to counting the rows of the line-level self join (anchor line x
    non-anchor line of the same basket), computed from per-basket multiplicities.

    A basket's pairs form a grid, anchors by companions. It is cut on both sides into a x b buckets
    of about ``pairs_per_bucket`` pairs: anchors pick a row and are copied along it, companions pick a
    column. Every (anchor, companion) pair meets in exactly one bucket, so counts are exact,
    and a basket that holds a third of all lines is spread over many tasks. The items table is
    written once, and both sides and the basket sizes are read from it; hot baskets are split before the first join.
    """
    items = materialize(_weighted_items(rows))
    is_anchor = F.col("category") == anchor
    sizes = items.groupBy("transaction_id").agg(F.count_if(is_anchor).alias("na"), F.count_if(~is_anchor).alias("nb"))
    side = pairs_per_bucket ** 0.5  # items of either side in a full bucket
    sizes = materialize(sizes.select("transaction_id", F.ceil(F.col("na") / side).cast("int").alias("__a"), F.ceil(F.col("nb") / side).cast("int").alias("__b"),
                                     (F.col("na") + F.col("nb")).alias("__items")))
    # a basket that holds a large share of all items is dealt out before it meets its size
    sized = join_split(items, sizes, "transaction_id", "__items", wanted=(F.col("__a") > 0) & (F.col("__b") > 0))
    anchors = sized.where(is_anchor).select(
        "transaction_id", F.col("productkey").alias("bike_key"), F.col("m").alias("ma"),
        F.pmod(F.xxhash64("productkey"), F.col("__a")).cast("int").alias("__row"),
        F.explode(F.sequence(F.lit(0), F.col("__b") - 1)).alias("__col"))
    companions = sized.where(~is_anchor).select(
        "transaction_id", F.col("productkey").alias("product_key"), F.col("category").alias("product_category"),
        F.col("m").alias("mb"), F.pmod(F.xxhash64("productkey", "category"), F.col("__b")).cast("int").alias("__col"),
        F.explode(F.sequence(F.lit(0), F.col("__a") - 1)).alias("__row"))
    pairs = anchors.join(companions, ["transaction_id", "__row", "__col"])
    return (pairs.groupBy("bike_key", "product_key", "product_category")
            .agg(F.sum(F.col("ma") * F.col("mb")).alias("count")))


def top_per_group(counts: DataFrame, n: int = 3) -> DataFrame:
    """rank() over (bike_key, product_category) by count desc; keep rank <= n (ties kept)."""
    w = Window.partitionBy("bike_key", "product_category").orderBy(F.desc("count"))
    return counts.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= n)


def top_lists(top: DataFrame, n: int = 3) -> DataFrame:
    """Top_Product_1..n per bike.

    Order within a bike: count desc, then category, then product key (keeps each
    category's rank order; the reference's collect order is arrival order).
    Positions come from a row_number bounded by n, so a bike with many tied
    companions never collects an unbounded list.
    """
    w = Window.partitionBy("bike_key").orderBy(F.desc("count"), F.asc("product_category"),
                                               F.asc("product_key"))
    pos = top.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
    return pos.groupBy("bike_key").agg(
        *[F.max(F.when(F.col("pos") == i, F.col("product_key"))).alias(f"Top_Product_{i}")
          for i in range(1, n + 1)])


def upsell_table(lists: DataFrame, names: DataFrame, key_col: str = "ProductKey",
                 name_col: str = "EnglishProductName", n: int = 3) -> DataFrame:
    """bike_name, upsell_1..n resolved through the product dimension (missing keys stay NULL).

    The n + 1 key columns are turned into rows and resolved by one join; rows without a key are not joined at all.
    """
    targets = {"bike_key": "bike_name"} | {f"Top_Product_{i}": f"upsell_{i}" for i in range(1, n + 1)}
    keyed = F.array(*[F.struct(F.lit(alias).alias("slot"), F.col(column).alias("key")) for column, alias in targets.items()])
    rows = lists.select("bike_key", F.explode(keyed).alias("t")).select("bike_key", "t.slot", "t.key").where(F.col("key").isNotNull())
    side = names.select(F.col(key_col).alias("key"), F.col(name_col).alias("name"))
    return (rows.join(side, "key", "left").groupBy("bike_key")
            .agg(*[F.max(F.when(F.col("slot") == alias, F.col("name"))).alias(alias) for alias in targets.values()])
            .select(*targets.values()))
