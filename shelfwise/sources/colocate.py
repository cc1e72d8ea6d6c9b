"""Facts laid out for joins without an exchange: external tables bucketed and sorted on their join key.

A table pays one shuffle when it is written; every later join, grouping or window on the same keys reads bucket i of
both sides in one task. Both sides need the same keys and the same number of buckets (else Spark puts the exchange
back, the rows stay the same). The write deals rows by the hash that buckets use, so each bucket is one file.

Defined cases: rows with a null in the key share one bucket; an empty table has no files and reads as no rows; writing a table
that exists is an error, as its readers may be running (write a new name, then switch to it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS_SETTING = "spark.sql.shuffle.partitions"


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions, so a bucket is what a shuffle task would get; the binding raises
    that number with the order lines (``session.size_shuffles``), and with it the buckets."""
    return int(spark.conf.get(BUCKETS_SETTING))


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the new catalog table ``table`` under ``path``, bucketed and sorted by ``keys``; returns it as it is stored."""
    spark = df.sparkSession
    buckets = buckets or default_buckets(spark)
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).mode("errorifexists").saveAsTable(table))
    return spark.table(table)
