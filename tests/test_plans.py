"""Plan-shape checks: pruning, pushdown, no Python in the hot path, no cartesian products."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMOKE
from shelfwise.operators import customer, ranking, serving
from shelfwise.plans import catalog as C
from shelfwise.sources.binding import bind


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schema(plan: str, table: str) -> set[str]:
    m = re.search(rf"{table}\.parquet.*?ReadSchema: struct<([^>]*)>", plan, re.S)
    assert m, f"no scan of {table}"
    return {f.split(":")[0] for f in m.group(1).split(",")}


PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


# the ridge systems, one small matrix a product, are solved in Arrow batches by design: these may hold that one Python node
SOLVED_IN_BATCHES = {"seasonal_forecast", "seasonal_equations"}


def test_no_python_or_cartesian_in_any_query(spark):
    skip = {"ingest_roundtrip", "clustered_write", "append_returns", "json_export", "returns_stream", "replace_append_table",
            "propensity_scores", "propensity_facts", "model_chain"}
    for name, fn in C.QUERIES.items():
        if name in skip:
            continue
        plan = _plan(fn(spark, SF_SMOKE))
        assert [p for p in PY_NODES if p in plan] == (["MapInPandas"] if name in SOLVED_IN_BATCHES else []), name
        assert "CartesianProduct" not in plan, name


def test_flagship_scan_is_pruned(spark):
    # the summary is written once; the plan that reads the fact is that of its input
    plan = _plan(customer.order_summary(bind(spark, SF_SMOKE).fact_internet_sales))
    assert _read_schema(plan, "lineitem") == {"l_orderkey", "l_quantity", "l_extendedprice", "l_discount"}
    assert _read_schema(plan, "orders") == {"o_orderkey", "o_custkey", "o_orderdate"}


def test_customer_filter_reaches_the_scan(spark):
    w = bind(spark, SF_SMOKE)
    df = serving.order_history(w.fact_internet_sales, w.dim_date, customer_key=7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,7\)", plan), plan


def test_distributed_rank_has_no_single_partition_over_rows(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("v"))
    table = ranking.global_rank_table(df, [("v", True)], num_partitions=4)
    plan = _plan(table)
    # the only single-partition exchange allowed is the per-partition offset table (n rows)
    assert plan.count("SinglePartition") <= 1


def test_forecast_does_not_build_the_grid(spark):
    plan = _plan(C.q_demand_forecast(spark, SF_SMOKE))
    # from the materialised per-product sums: no scan of the fact, no day sequence but the 28-day horizon
    assert plan.count("Generate") == 1 and "lineitem" not in plan


def test_metrics_and_360_read_the_materialised_summary(spark):
    plan = _plan(C.q_customer_metrics(spark, SF_SMOKE))
    assert "lineitem" not in plan and "Scan ExistingRDD" in plan


def test_no_window_over_an_unpartitioned_table(spark):
    """The ranked queries number rows inside ranges; only tables with one row per range meet in one partition."""
    for name in ("quartiles", "demand_rank", "inventory_status"):
        plan = _plan(C.QUERIES[name](spark, SF_SMOKE))
        for window in re.findall(r"Window \[.*\n", plan):
            assert "__pid" in window or "__pm" in window or "Monday" in window or "ProductKey" in window, (name, window)


def test_binding_dimension_keys_are_unique(spark):
    w = bind(spark, "/root/testdata/sf0.01")
    for dim, key in [("dim_product", "ProductKey"), ("dim_product_subcategory", "ProductSubcategoryKey"),
                     ("dim_product_category", "ProductCategoryKey"), ("dim_customer", "CustomerKey"),
                     ("dim_date", "DateKey"), ("dim_sales_reason", "SalesReasonKey")]:
        df = getattr(w, dim)
        assert df.select(key).distinct().count() == df.count(), dim
