"""Query catalog: every operator of the inventory as ``(spark, sf_dir) -> DataFrame``.

Each query binds the canonical warehouse over the given directory (lazily) and
composes operators; nothing is collected. Parameters bound here for the
driver tables: anchor category 'Brand#2' (plays the reference's 'Bikes'),
fiscal year 2000, as-of date 2002-01-01, search query vector id 0, returned
lines = lineitem rows with return flag 'R'.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import basket, customer, forecast, inventory, mining, propensity, seasonal, serving, star, text
from shelfwise.sources import footers, ingest, publish
from shelfwise.operators.ranking import materialize
from shelfwise.session import checkpoint_dir, side_by_side
from shelfwise.sources.binding import ANCHOR_CATEGORY, Warehouse, bind
from shelfwise.sources.colocate import write_bucketed
from shelfwise.sources.raw import read_table
from shelfwise.streaming import returns as returns_stream

FISCAL_YEAR = 2000
AS_OF = "2002-01-01"
QUERY_VEC_ID = 0
SEARCH_K = 10
MATCH_K = 3
KEYWORDS_K = 8
LAYOUT_DATES = ("1995-01-01", "1995-06-30")
# parameters of the time-series view over the driver tables' product types
TS_MODELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TS_SUCCESSOR = {"ECONOMY": "SARD", "SMALL": "MIUM"}
# tables and the columns whose maxima their files' footers give; the ship date, a timestamp, is scanned
FOOTER_AUDIT = [("lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"]), ("orders", ["o_orderkey", "o_custkey"]),
                ("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("supplier", ["s_suppkey"]), ("events", ["event_id", "user_id"])]
# (application, warehouse folder) -> where its inventory status is published
_STATUS_ROOTS: dict[tuple[str, str], str] = {}
# (application, warehouse folder, fact) -> its bucketed copy's table name
_BUCKETED: dict[tuple[str, str, str], str] = {}


# ------------------------------------------------------------ shared pieces

def sales_view(w: Warehouse, need: set[str] | None = None) -> DataFrame:
    return star.v_fact_internet_sales(w, need=need)


def _prep(w: Warehouse) -> DataFrame:
    return mining.dm_prep(w, AS_OF)


def _basket_rows(w: Warehouse) -> DataFrame:
    v = star.v_fact_reseller_sales(w, need={"SalesOrderNumber", "ProductKey", "EnglishProductCategoryName"})
    return basket.basket_rows(v)


def _top(w: Warehouse) -> DataFrame:
    return basket.top_per_group(basket.pair_counts(_basket_rows(w), ANCHOR_CATEGORY), 3)


def _upsells(w: Warehouse) -> DataFrame:
    return basket.upsell_table(basket.top_lists(_top(w), 3), w.dim_product)


def _scores(w: Warehouse) -> DataFrame:
    # spend, purchase probability and revenue come out of the materialised customer summary
    return customer.model_scores(w.customer_inputs, None, None, w.bike_score_input)


def _metrics(w: Warehouse) -> DataFrame:
    return customer.customer_metrics(w.customer_summary, w.dim_customer)


def _customer_360(w: Warehouse) -> DataFrame:
    metrics = _metrics(w)  # writes the customer summary that the ranks read
    view = sales_view(w, need={"CustomerKey", "EnglishProductName"})
    # ranks and baskets are independent jobs
    ranks, upsells = side_by_side(lambda build: build(), [
        lambda: customer.customer_ranks(_scores(w)), lambda: customer.customer_upsells(view, _upsells(w))], 2)
    return customer.customer_360(metrics, ranks, upsells)


def _weekly(w: Warehouse) -> DataFrame:
    return forecast.weekly_buckets(forecast.forecast_demand(w.fact_internet_sales))


def _status(w: Warehouse) -> DataFrame:
    stock = star.stock_position(w.fact_product_inventory)
    # the order lines are joined and summed once, for the forecast and for the margin
    sums = forecast.product_sums(w.fact_internet_sales, also=("Profit", "SalesAmount"))
    weekly = forecast.weekly_buckets(forecast.forecast_demand(w.fact_internet_sales, sums=sums))
    ranked = inventory.rank_demand(inventory.demand(stock, weekly))
    return inventory.inventory_status(inventory.reorder_policy(ranked), inventory.margin(sums))


def _stored_status(w: Warehouse) -> DataFrame:
    """The published product_inventory_status that search and lookups read; the first use over a warehouse in a session publishes it."""
    key = (w.spark.sparkContext.applicationId, w.sf_dir)
    if key not in _STATUS_ROOTS:
        root = _scratch(w.spark, "product_inventory_status")
        inventory.publish_status(_status(w), root)
        _STATUS_ROOTS[key] = root
    return publish.read_published(w.spark, _STATUS_ROOTS[key])


def _hits(w: Warehouse) -> DataFrame:
    emb = w.raw("embeddings")
    q = text.query_vector(emb, "vec_id", "embedding", QUERY_VEC_ID)
    top = text.cosine_topk(emb, "vec_id", "embedding", q, SEARCH_K)
    return top.select(F.col("vec_id").alias("productkey"), F.round("score", 6).alias("score"))


def _returns(w: Warehouse) -> DataFrame:
    l = w.raw("lineitem").filter(F.col("l_returnflag") == "R")
    return l.select(F.col("l_orderkey").alias("OrderNumber"), F.col("l_linenumber").alias("LineNumber"))


def _email(w: Warehouse) -> DataFrame:
    v = sales_view(w, need={"EmailAddress", "FirstName", "LastName", "EnglishProductName", "CustomerKey"})
    return text.return_email_json(v, _returns(w))


def _arr(c: str) -> F.Column:
    return F.when(F.col(c).isNotNull(), F.concat_ws("|", F.col(c))).alias(c)


# ------------------------------------------------------------------ queries

def q_customer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(bind(spark, sf))


def q_population_averages(spark, sf):
    return customer.population_averages(bind(spark, sf).customer_summary)


def q_star_internet_sales(spark, sf):
    return star.v_fact_internet_sales(bind(spark, sf))


def q_star_reseller_sales(spark, sf):
    return star.v_fact_reseller_sales(bind(spark, sf))


def q_star_sales_reason(spark, sf):
    return star.v_fact_internet_sales_reason(bind(spark, sf))


def _bucketed_fact(w: Warehouse, fact: str) -> DataFrame:
    """The sales fact bucketed on (order, line), written once per application and folder."""
    key = (w.spark.sparkContext.applicationId, w.sf_dir, fact)
    if key in _BUCKETED:
        return w.spark.table(_BUCKETED[key])
    name = f"{fact}_{uuid.uuid4().hex}"
    out = write_bucketed(getattr(w, fact), name, f"{checkpoint_dir(w.spark).rstrip('/')}/{name}",
                         ["SalesOrderNumber", "SalesOrderLineNumber"])
    _BUCKETED[key] = name
    return out


def q_sales_reason_colocated(spark, sf):
    w = bind(spark, sf)
    return star.v_fact_internet_sales_reason(SimpleNamespace(
        dim_sales_reason=w.dim_sales_reason, dim_date=w.dim_date,
        fact_internet_sales=_bucketed_fact(w, "fact_internet_sales"),
        fact_internet_sales_reason=_bucketed_fact(w, "fact_internet_sales_reason")))


def q_star_call_center(spark, sf):
    return star.v_fact_call_center(bind(spark, sf))


def q_star_survey(spark, sf):
    return star.v_fact_survey_response(bind(spark, sf))


def q_star_currency_rate(spark, sf):
    return star.v_fact_currency_rate(bind(spark, sf))


def q_star_finance(spark, sf):
    return star.v_fact_finance(bind(spark, sf))


def q_star_sales_quota(spark, sf):
    return star.v_fact_sales_quota(bind(spark, sf))


def q_stock_position(spark, sf):
    return star.stock_position(bind(spark, sf).fact_product_inventory)


def q_dm_prep(spark, sf):
    return _prep(bind(spark, sf))


def q_dm_null_violations(spark, sf):
    return mining.null_violations(_prep(bind(spark, sf)))


def q_assoc_line_items(spark, sf):
    return mining.assoc_line_items(_prep(bind(spark, sf)), FISCAL_YEAR)


def q_assoc_orders(spark, sf):
    return mining.assoc_orders(_prep(bind(spark, sf)), FISCAL_YEAR)


def q_target_mail(spark, sf):
    w = bind(spark, sf)
    return mining.target_mail(_prep(w), w.dim_customer, ANCHOR_CATEGORY)


def q_time_series(spark, sf):
    return mining.time_series(_prep(bind(spark, sf)), TS_MODELS, TS_SUCCESSOR)


def q_category_diversity(spark, sf):
    return basket.category_diversity(_basket_rows(bind(spark, sf)))


def q_anchor_basket_lines(spark, sf):
    return basket.anchor_baskets(_basket_rows(bind(spark, sf)), ANCHOR_CATEGORY)


def q_pair_counts(spark, sf):
    return basket.pair_counts(_basket_rows(bind(spark, sf)), ANCHOR_CATEGORY)


def q_top_products(spark, sf):
    return _top(bind(spark, sf))


def q_top_products_by_name(spark, sf):
    """Coarser grain where the rank filter bites: basket item = product name, category = type."""
    w = bind(spark, sf)
    p = w.dim_product.select("ProductKey", "EnglishProductName", "ModelName", "ProductSubcategoryKey")
    brand = w.dim_product_subcategory.select("ProductSubcategoryKey", "p_brand")
    lines = (w.fact_reseller_sales.select("SalesOrderNumber", "ProductKey").join(p, "ProductKey", "left")
             .join(brand, "ProductSubcategoryKey", "left"))
    cat = F.when(F.col("p_brand") == ANCHOR_CATEGORY, "Anchor").otherwise(F.col("ModelName"))
    rows = basket.basket_rows(lines.withColumn("cat", cat), item_col="EnglishProductName",
                              category_col="cat", default_category="Other")
    return basket.top_per_group(basket.pair_counts(rows, "Anchor"), 3)


def q_top_lists(spark, sf):
    return basket.top_lists(_top(bind(spark, sf)), 3)


def q_upsell_table(spark, sf):
    return _upsells(bind(spark, sf))


def _labels(w: Warehouse) -> DataFrame:
    """One row per customer of the sales: attributes and whether they bought the anchor category."""
    return propensity.customer_labels(sales_view(w, need={"EnglishProductCategoryName"}), w.dim_customer, ANCHOR_CATEGORY)


def _training(w: Warehouse) -> DataFrame:
    return materialize(propensity.training_set(_labels(w), AS_OF))


def q_buyers(spark, sf):
    return propensity.buyers(_labels(bind(spark, sf)))


def q_non_buyers(spark, sf):
    return propensity.non_buyers(_labels(bind(spark, sf)))


def q_training_set(spark, sf):
    return propensity.training_set(_labels(bind(spark, sf)), AS_OF)


def q_propensity_scores(spark, sf):
    """Scores of the non-buyers, best first, saved as a table and read back; the fit repeats to a stated tolerance."""
    rows = materialize(propensity.coded(propensity.training_set(_labels(bind(spark, sf)), AS_OF)))
    path = _scratch(spark, "bike_scores")
    propensity.save_scores(propensity.newton_scores(propensity.newton_fit(rows), rows), path)
    return spark.read.parquet(path).orderBy(F.desc("score"), F.asc("customerkey"))


def q_propensity_equations(spark, sf):
    """The score equations of the model behind ``propensity_scores``, which only the maximum of the likelihood solves."""
    rows = materialize(propensity.coded(propensity.training_set(_labels(bind(spark, sf)), AS_OF)))
    return propensity.score_equations(propensity.newton_fit(rows), rows)


def q_propensity_facts(spark, sf):
    """What must hold for the fitted model whatever the solver's noise: who is scored, the range, the calibration."""
    train = _training(bind(spark, sf))
    model = propensity.fit(train)
    scores = propensity.score(model, train)
    scored = scores.agg(F.count(F.lit(1)).alias("scored"), F.countDistinct("customerkey").alias("customers"),
                        F.sum("customerkey").alias("key_sum"),
                        F.count_if((F.col("score") >= 0) & (F.col("score") <= 1)).alias("in_range"))
    fitted = propensity.probabilities(model, train).agg(F.sum("p").alias("expected"), F.sum("BikeBuyer").alias("buyers"))
    near = F.abs(F.col("expected") - F.col("buyers")) <= 0.001 * F.col("buyers")
    return scored.crossJoin(F.broadcast(fitted)).select("scored", "customers", "key_sum", "in_range", "buyers", near.alias("calibrated"))


def q_model_chain(spark, sf):
    """C15 -> C17 -> C18/C19 with the fitted model's saved scores in place of the stand-in: who gets which kind of quartile."""
    w = bind(spark, sf)
    train = _training(w)
    path = _scratch(spark, "bike_scores")
    propensity.save_scores(propensity.score(propensity.fit(train), train), path)
    ranks = customer.customer_ranks(customer.model_scores(w.customer_inputs, None, None, spark.read.parquet(path)))
    return ranks.select("customerkey", (F.col("score_quartile") > 0).alias("scored"))


def q_customer_revenue(spark, sf):
    return customer.customer_revenue(bind(spark, sf).fact_internet_sales)


def q_model_scores(spark, sf):
    return _scores(bind(spark, sf))


def q_quartiles(spark, sf):
    return customer.customer_ranks(_scores(bind(spark, sf)))


def q_customer_upsells(spark, sf):
    w = bind(spark, sf)
    u = customer.customer_upsells(sales_view(w, need={"CustomerKey", "EnglishProductName"}), _upsells(w))
    return u.select("customerkey", _arr("upsell_list"))


def q_customer_360(spark, sf):
    d = _customer_360(bind(spark, sf))
    return d.select(*[c for c in d.columns if c != "upsell_list"], _arr("upsell_list"))


def q_badges(spark, sf):
    return customer.badges(_customer_360(bind(spark, sf)))


def q_first_sale(spark, sf):
    return forecast.first_sale(bind(spark, sf).fact_internet_sales)


def q_demand_grid_stats(spark, sf):
    return forecast.grid_stats(forecast.daily_demand(bind(spark, sf).fact_internet_sales))


def q_demand_forecast(spark, sf):
    return forecast.forecast_demand(bind(spark, sf).fact_internet_sales)


def q_seasonal_forecast(spark, sf):
    """I5 with yearly waves and a bending trend; values are tested against dense least squares, no SQL."""
    return seasonal.seasonal_forecast(bind(spark, sf).fact_internet_sales)


def q_seasonal_equations(spark, sf):
    """The normal equations behind ``seasonal_forecast``, both sides per product and basis function."""
    return seasonal.seasonal_equations(bind(spark, sf).fact_internet_sales)


def q_weekly_demand(spark, sf):
    return _weekly(bind(spark, sf))


def q_margin(spark, sf):
    return inventory.margin(bind(spark, sf).fact_internet_sales)


def q_demand_rank(spark, sf):
    w = bind(spark, sf)
    return inventory.rank_demand(inventory.demand(star.stock_position(w.fact_product_inventory), _weekly(w)))


def q_inventory_status(spark, sf):
    return _status(bind(spark, sf))


def q_distinct_descriptions(spark, sf):
    return inventory.distinct_descriptions(bind(spark, sf).dim_product)


def q_describable_products(spark, sf):
    w = bind(spark, sf)
    return text.describable_products(w.dim_product, w.dim_product_subcategory, w.dim_product_category,
                                     ANCHOR_CATEGORY).drop("p_brand", "p_type")


def q_prompts(spark, sf):
    w = bind(spark, sf)
    return text.prompts(text.describable_products(w.dim_product, w.dim_product_subcategory,
                                                  w.dim_product_category, ANCHOR_CATEGORY))


def q_keywords(spark, sf):
    return text.keywords(bind(spark, sf).raw("documents"), "doc_id", "text", KEYWORDS_K)


def _product_keywords(w: Warehouse) -> DataFrame:
    d = text.describable_products(w.dim_product, w.dim_product_subcategory, w.dim_product_category,
                                  ANCHOR_CATEGORY)
    kw = text.keywords(d, "ProductKey", "EnglishDescription", KEYWORDS_K)
    return d.select(F.col("ProductKey").alias("productkey"), F.col("EnglishDescription").alias("description")) \
            .join(kw.withColumnRenamed("ProductKey", "productkey"), "productkey", "left")


def q_product_keywords(spark, sf):
    return _product_keywords(bind(spark, sf))


def q_similarity_search(spark, sf):
    """T4 with its three columns."""
    w = bind(spark, sf)
    return text.similarity_search(_hits(w), _product_keywords(w))


def q_cosine_topk(spark, sf):
    emb = bind(spark, sf).raw("embeddings")
    q = text.query_vector(emb, "vec_id", "embedding", QUERY_VEC_ID)
    top = text.cosine_topk(emb, "vec_id", "embedding", q, SEARCH_K)
    return top.select("vec_id", F.round("score", 6).alias("score"))


def q_cosine_topk_many(spark, sf):
    emb = bind(spark, sf).raw("embeddings")
    queries = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    out = text.cosine_topk_many(emb, "vec_id", "embedding", queries, "label", "q", MATCH_K)
    return out.select(F.col("query_id").alias("label"), "vec_id", F.round("score", 6).alias("score"), "rank")


def q_search_enriched(spark, sf):
    w = bind(spark, sf)
    return text.search_enriched(_hits(w), w.dim_product, _stored_status(w))


def q_search_described(spark, sf):
    w = bind(spark, sf)
    return text.search_described(_hits(w), w.dim_product, _stored_status(w))


def q_recap_json(spark, sf):
    return text.recap_json(_customer_360(bind(spark, sf)))


def q_return_email_json(spark, sf):
    return _email(bind(spark, sf))


def q_order_json(spark, sf):
    return text.order_json(_email(bind(spark, sf)))


def q_customers(spark, sf):
    return serving.customers(sales_view(bind(spark, sf), need={"FirstName", "LastName", "EmailAddress",
                                                               "AddressLine1"}))


def q_order_history(spark, sf):
    w = bind(spark, sf)
    return serving.order_history(w.fact_internet_sales, w.dim_date)


def q_order_lines(spark, sf):
    w = bind(spark, sf)
    return serving.order_lines(sales_view(w, need={"EnglishProductName"}), w.dim_date)


def q_stocked_products(spark, sf):
    w = bind(spark, sf)
    return serving.stocked_products(w.dim_product, _stored_status(w))


def q_inventory_lookup(spark, sf):
    return serving.inventory_lookup(_stored_status(bind(spark, sf)))


def q_picker_labels(spark, sf):
    w = bind(spark, sf)
    return serving.picker_labels(serving.customers(sales_view(w, need={"FirstName", "LastName", "EmailAddress",
                                                                      "AddressLine1"})))


def q_freshness(spark, sf):
    w = bind(spark, sf)
    return ingest.freshness([
        ("DimCustomer", "DateFirstPurchase", w.dim_customer),
        ("DimDate", "FiscalYear", w.dim_date),
        ("DimPromotion", "EndDate", w.dim_promotion),
        ("DimEmployee", "StartDate", w.dim_employee),
        ("DimProduct", "EndDate", w.dim_product),
        ("FactCallCenter", "Date", w.fact_call_center),
        ("FactFinance", "Date", w.fact_finance),
        ("FactInternetSales", "ShipDate", w.fact_internet_sales),
        ("FactResellerSales", "OrderDate", w.fact_reseller_sales),
        ("FactSurveyResponse", "Date", w.fact_survey_response),
    ])


def q_freshness_footers(spark, sf):
    return footers.audit(spark, lambda session, table: read_table(session, sf, table), FOOTER_AUDIT)


def q_reconcile(spark, sf):
    w = bind(spark, sf)
    return ingest.reconcile([("lineitem", w.raw("lineitem"), F.col("l_shipdate") < F.lit("2001-01-01"))])


def q_profit(spark, sf):
    l = bind(spark, sf).raw("lineitem")
    facts = l.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.col("l_extendedprice").alias("ExtendedAmount"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("SalesAmount"),
                     (F.col("l_extendedprice") * F.lit(0.6)).cast("decimal(18,4)").alias("TotalProductCost"))
    return ingest.add_profit(facts)


def q_shift_dates(spark, sf):
    o = bind(spark, sf).raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return ingest.shift_dates(o, ["o_orderdate"], months=132, cutoff="2010-04-30", cutoff_col="o_orderdate")


def q_shift_employees(spark, sf):
    """S7 with several cutoffs: start before the cutoff and end before it or open."""
    return ingest.shift_table(bind(spark, sf).dim_employee, "DimEmployee", cutoff="2007-06-01")


def q_shift_calendar(spark, sf):
    """S7 with year columns: dates move by months, years by whole years; every day of the calendar."""
    return ingest.shift_table(bind(spark, sf).dim_date, "DimDate")


# ------------------------------------------------- sinks (write, read back)

def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# Fixed values of the round-trip catalog over the driver tables: table -> cluster keys.
DRIVER_CATALOG = {"lineitem": "l_orderkey,l_linenumber", "orders": "o_orderkey", "customer": "c_custkey",
                  "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey",
                  "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
                  "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id,turn"}


def q_ingest_roundtrip(spark, sf):
    """Catalog-driven clustered ingest of all tables, then each source and its written copy compared
    by row count and by an order-independent sum of row hashes."""
    root = _scratch(spark, "warehouse")
    read = lambda t: read_table(spark, sf, t)
    ingest.ingest(spark, read, root, catalog=DRIVER_CATALOG, versioned=True)
    return ingest.verify_roundtrip(spark, read, root, DRIVER_CATALOG, versioned=True)


def q_clustered_write(spark, sf):
    """The internet-sales fact published range-clustered by (order, line), replaced by a version made from itself, read back."""
    root, keys = _scratch(spark, "fact_internet_sales"), ["SalesOrderNumber", "SalesOrderLineNumber"]
    ingest.publish_clustered(bind(spark, sf).fact_internet_sales, keys, root)
    ingest.publish_clustered(publish.read_published(spark, root), keys, root)
    return publish.read_published(spark, root)


def q_interleaved_write(spark, sf):
    """The internet-sales fact published in the interleaved order of product and date, read back by a range of the second."""
    root = _scratch(spark, "fact_internet_sales_interleaved")
    ingest.publish_clustered(bind(spark, sf).fact_internet_sales, ["ProductKey", "OrderDate"], root, interleaved=True)
    return publish.read_published(spark, root).where(F.col("OrderDate").between(*LAYOUT_DATES))


def q_replace_append_table(spark, sf):
    """A catalog table replaced twice (the second schema wins), then appended to, read back and dropped."""
    orders = bind(spark, sf).raw("orders")
    name = f"shelfwise_orders_{uuid.uuid4().hex}"
    ingest.replace_table(orders.select("o_orderkey"), name)
    ingest.replace_table(orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), name, ["o_orderkey"])
    ingest.append_table(orders.where("o_orderkey % 2 <> 0").select("o_orderstatus", "o_orderkey"), name)
    out = materialize(spark.table(name))
    publish.drop(spark, name)
    return out


def q_append_returns(spark, sf):
    """Validated returned lines appended to a returns table, read back."""
    w = bind(spark, sf)
    path = _scratch(spark, "fact_returns")
    ingest.append_returns(_returns(w), w.fact_internet_sales, path)
    return spark.read.parquet(path)


def q_json_export(spark, sf):
    """Customer metrics exported as JSON lines, read back with the same schema."""
    m = _metrics(bind(spark, sf))
    path = _scratch(spark, "customer_metrics_json")
    ingest.json_export(m, path)
    return spark.read.schema(m.schema).json(path)


def q_returns_stream(spark, sf):
    """S11+T9 as a stream: returned lines land as files, the stream validates and appends them
    and their e-mail payloads; returns the payload table."""
    w = bind(spark, sf)
    landing, ret_path, pay_path = (_scratch(spark, n) for n in ("returns-landing", "fact_returns", "payloads"))
    _returns(w).write.parquet(landing)
    v = sales_view(w, need={"EmailAddress", "FirstName", "LastName", "EnglishProductName", "CustomerKey"})
    q = returns_stream.start_returns_stream(spark, landing, v, ret_path, pay_path, _scratch(spark, "returns-checkpoint"))
    q.awaitTermination()
    return spark.read.parquet(pay_path).drop("stream", "batch_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_") and callable(fn)
}
