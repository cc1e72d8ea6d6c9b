"""Daily demand, per-product forecast and weekly buckets.

Forecast model (fixed once, mirrored in the SQL oracle): for each product,
t = days since its first sale, y = units sold that day, zero-filled up to the
global last sale day. Least-squares trend y ~ a + b t over the dense series,
plus a day-of-week effect = mean residual of that weekday. Future value
yhat = half-even round(max(a + b t + effect, 0)). With one day of history b = 0.

Over a zero-filled series every sum the fit needs is either closed-form in n
(number of days) or a sum over the *sparse* sale rows, so the forecast never
materialises the product x day grid: the fact rows are summed once per product
(``product_sums``), plus a one-row broadcast holding the last day.
The dense grid itself (``daily_demand``) is still provided, generated from the
sparse rows by gap filling inside each product, never by shuffling grid rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.ranking import materialize

# Forecast horizon (days) and the number of weekly buckets kept.
HORIZON_DAYS = 28
WEEKS = 4
_EPOCH = "1970-01-01"


def _daynum(c) -> F.Column:
    return F.datediff(c, F.to_date(F.lit(_EPOCH)))


def first_sale(sales: DataFrame, date_col: str = "OrderDate") -> DataFrame:
    """(ProductKey, FirstSaleDate)."""
    return sales.groupBy("ProductKey").agg(F.min(date_col).alias("FirstSaleDate"))


def last_day(sales: DataFrame, date_col: str = "OrderDate") -> DataFrame:
    """One row, the global last sale date."""
    return sales.agg(F.max(date_col).alias("MaxDate"))


def sparse_daily(sales: DataFrame, date_col: str = "OrderDate", qty_col: str = "OrderQuantity") -> DataFrame:
    """Units per (product, day) over days with sales only (pre-aggregated before any join)."""
    return sales.groupBy("ProductKey", F.col(date_col).alias("ds")).agg(F.sum(qty_col).alias("y"))


def daily_demand(sales: DataFrame, date_col: str = "OrderDate", qty_col: str = "OrderQuantity") -> DataFrame:
    """I3+I4: dense zero-filled (ProductKey, ds, y) from first sale to the global last day.

    Each sparse row expands to itself plus the zero days up to the next sale day
    (``lead`` within the product), so the grid is produced where the sparse row
    lives; only sparse rows are shuffled.
    """
    sp = sparse_daily(sales, date_col, qty_col)
    mx = F.broadcast(last_day(sales, date_col))
    nxt = F.lead("ds").over(Window.partitionBy("ProductKey").orderBy("ds"))
    seg = sp.crossJoin(mx).withColumn("__end", F.coalesce(F.date_sub(nxt, 1), F.col("MaxDate")))
    days = seg.select("ProductKey", "ds", "y", F.explode(F.sequence("ds", "__end")).alias("__d"))
    return days.select("ProductKey", F.col("__d").alias("ds"),
                       F.when(F.col("__d") == F.col("ds"), F.col("y")).otherwise(F.lit(0)).cast("bigint")
                       .alias("y"))


def grid_stats(dense: DataFrame) -> DataFrame:
    """Per-product summary of the dense grid: first day, days, zero days, total units."""
    return dense.groupBy("ProductKey").agg(
        F.min("ds").alias("first_ds"), F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("y") == 0).alias("zero_days"), F.sum("y").alias("total"))


def product_sums(sales: DataFrame, date_col: str = "OrderDate", qty_col: str = "OrderQuantity", also: tuple[str, ...] = ()) -> DataFrame:
    """Per product, written once: first and last sale day, units, units * day, units by weekday class, and sums of the ``also`` columns.

    A product's lines are few and spread over all tasks, and the sums of one line are much wider than the line. So the lines move, by product
    and weekday, and are summed where they meet; only those sums, at most 7 rows a product, move on, before they
    are turned into columns. A product that most lines share is dealt to 7 tasks.
    """
    d = _daynum(F.col(date_col))
    lines = sales.select("ProductKey", d.alias("__d"), F.col(qty_col).cast("bigint").alias("__q"), *also)
    by_weekday = lines.repartition("ProductKey", F.pmod("__d", F.lit(7))).groupBy("ProductKey", F.pmod("__d", F.lit(7)).alias("__k")).agg(
        F.min("__d").alias("d0"), F.max("__d").alias("d1"), F.sum("__q").alias("Sy"), F.sum(F.col("__q") * F.col("__d")).alias("Syd"),
        *[F.sum(c).alias(c) for c in also])
    return materialize(by_weekday.repartition("ProductKey").groupBy("ProductKey").agg(
        F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.sum("Sy").alias("Sy"), F.sum("Syd").alias("Syd"),
        *[F.sum(F.when(F.col("__k") == k, F.col("Sy")).otherwise(F.lit(0))).alias(f"Sk{k}") for k in range(7)],
        *[F.sum(c).alias(c) for c in also]))


def fit_params(sales: DataFrame, date_col: str = "OrderDate", qty_col: str = "OrderQuantity", sums: DataFrame | None = None) -> DataFrame:
    """Per product: n, intercept a, slope b and the 7 weekday effects (relative to the first day).

    Sums over the fact rows (units, units * day and units per absolute weekday class: ``product_sums``, unless the
    caller has them as ``sums``); everything else is closed-form.
    """
    # one row per product, written once: the global last day comes from it and the fact is scanned once
    per = sums if sums is not None else product_sums(sales, date_col, qty_col)
    p = per.crossJoin(F.broadcast(per.agg(F.max("d1").alias("dmax"))))
    n = (F.col("dmax") - F.col("d0") + 1).cast("bigint")
    p = p.select("ProductKey", "d0", "dmax", "Sy", n.alias("n"),
                 (F.col("Syd") - F.col("d0") * F.col("Sy")).alias("Sty"),
                 *[F.col(f"Sk{k}") for k in range(7)])
    n = F.col("n")
    st = n * (n - 1) / 2                        # sum of t
    den = (n * n * (n * n - 1) / 12)            # n*Stt - St^2, exact
    slope = F.when(n <= 1, F.lit(0.0)).otherwise(
        (n.cast("double") * F.col("Sty").cast("double") - st.cast("double") * F.col("Sy").cast("double"))
        / den.cast("double"))
    p = p.select("*", st.cast("double").alias("St"), slope.alias("b"))
    a = (F.col("Sy").cast("double") - F.col("b") * F.col("St")) / n.cast("double")
    p = p.withColumn("a", a)
    effects = []
    for r in range(7):
        # days t = r, r+7, ... < n share the weekday of (first day + r)
        nr = F.when(n > r, F.floor((n - 1 - r) / 7) + 1).otherwise(F.lit(0)).cast("bigint")
        str_ = nr * r + 7 * nr * (nr - 1) / 2
        syr = F.lit(0)
        for k in range(7):
            syr = F.when(F.pmod(F.col("d0") + r, F.lit(7)) == k, F.col(f"Sk{k}")).otherwise(syr)
        eff = F.when(nr > 0, (syr.cast("double") - nr.cast("double") * F.col("a")
                              - F.col("b") * str_.cast("double")) / nr.cast("double")).otherwise(F.lit(0.0))
        effects.append(eff)
    return p.select("ProductKey", "d0", "dmax", "n", "a", "b", F.array(*effects).alias("effects"))


def forecast_demand(sales: DataFrame, horizon: int = HORIZON_DAYS, date_col: str = "OrderDate",
                    qty_col: str = "OrderQuantity", sums: DataFrame | None = None) -> DataFrame:
    """(ProductKey, ds, yhat) for the ``horizon`` days after the global last day."""
    # the products move before their days are made, so that what groups the days by product finds them together
    p = fit_params(sales, date_col, qty_col, sums).repartition("ProductKey")
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    x = p.select("ProductKey", "n", "a", "b", "effects", "dmax", h)
    t = F.col("n") - 1 + F.col("h")
    eff = F.element_at("effects", (F.pmod(t, F.lit(7)) + 1).cast("int"))
    raw = F.col("a") + F.col("b") * t.cast("double") + eff
    ds = F.date_add(F.to_date(F.lit(_EPOCH)), (F.col("dmax") + F.col("h")).cast("int"))
    return x.select("ProductKey", ds.alias("ds"), F.bround(F.round(F.greatest(raw, F.lit(0.0)), 6), 0).alias("yhat"))


def weekly_buckets(forecast: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """I6+I7: sum yhat per calendar (Monday-start) week; Week1 = the week of the first forecast
    day; keep ``weeks`` weeks, missing weeks 0; pivot to Week1Demand..WeekNDemand.

    Week slots are day offsets from the first week's Monday, so a horizon that
    crosses New Year keeps its order (ISO week numbers would wrap).
    """
    wk = F.date_trunc("week", F.col("ds")).cast("date")
    first_wk = F.min(wk).over(Window.partitionBy("ProductKey"))
    slotted = forecast.select("ProductKey", "yhat", wk.alias("wk"), first_wk.alias("fw"))
    slot = (F.datediff("wk", "fw") / 7 + 1).cast("int")
    slotted = slotted.select("ProductKey", "yhat", slot.alias("slot")).filter(F.col("slot") <= weeks)
    return slotted.groupBy("ProductKey").agg(
        *[F.sum(F.when(F.col("slot") == i, F.col("yhat")).otherwise(F.lit(0.0))).alias(f"Week{i}Demand")
          for i in range(1, weeks + 1)])
