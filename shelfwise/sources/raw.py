"""Readers for the driver's parquet tables (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# natural key of each table: used when an under-split scan is spread over the cores
RAW_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "labels": "doc_id", "conversations": "conv_id",
}
# session setting (unset by default, used by the benchmark on one machine): tables to spread and over how many
# partitions, as "lineitem=8,orders=8"
SPREAD_SETTING = "spark.shelfwise.scan.spread"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    Any path Spark can read works: the folder is not looked at from the driver. A file
    written as one row group scans as one task; where that matters (a benchmark on one machine)
    ``SPREAD_SETTING`` hash-partitions the tables it names on their natural keys right after the scan.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = dict(part.split("=") for part in spark.conf.get(SPREAD_SETTING, "").split(",") if part)
    return df.repartition(int(spread[name]), RAW_KEYS[name]) if name in spread else df
