"""Table audits answered from parquet footers (S8 maxima, S4 row counts).

Version 2 of the parquet source gives ``max`` and ``count`` of whole tables from the statistics in the file footers: the
executors open every file's footer and read no column. It is on only in a session of its own, which shares the
context and the settings of the caller's; the caller's scans stay as they are.

Integer and date columns are answered so. Other types (timestamps, text, decimals) are scanned, one pruned column each.
Defined cases: an empty table has null maxima and 0 rows; a file whose column holds nulls alone, or that was
written without statistics, has no maximum in its footer, so then that table is scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType

from shelfwise.session import side_by_side

PUSHDOWN = "spark.sql.parquet.aggregatePushdown"
VERSION_1 = "spark.sql.sources.useV1SourceList"
FOOTER_TYPES = (ByteType, ShortType, IntegerType, LongType, DateType)
AUDITS_AT_A_TIME = 4
AUDIT_SCHEMA = "`table` string, `column` string, max_value string, row_count bigint"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's SQL settings whose parquet reads may be answered from footers."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(VERSION_1, ",".join(s for s in own.conf.get(VERSION_1).split(",") if s.strip() != "parquet"))
    own.conf.set(PUSHDOWN, "true")
    return own


def maxima(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the maximum of every column, as ``m0``, ``m1``, ..., and the number of rows."""
    return df.agg(*[F.max(F.col(c)).cast("string").alias(f"m{i}") for i, c in enumerate(columns)],
                  F.count(F.lit(1)).alias("row_count"))


def audit(spark: SparkSession, read: Callable[[SparkSession, str], DataFrame],
          items: Iterable[tuple[str, list[str]]]) -> DataFrame:
    """(table, column, max_value as string, row_count) for (table, columns) items; ``read(session, table)`` gives the bare parquet table.

    The audit runs when it is called, a few tables at a time; one row per table comes to the driver.
    """
    own = footer_session(spark)

    def one(item: tuple[str, list[str]]) -> list[tuple]:
        table, columns = item
        df = read(own, table)
        cheap = [c for c in columns if isinstance(df.schema[c].dataType, FOOTER_TYPES)]
        dear = [c for c in columns if c not in cheap]
        try:
            found = maxima(df, cheap).first()
        except (Py4JJavaError, PySparkException) as e:
            if PUSHDOWN not in str(e):
                raise
            found = maxima(read(spark, table), cheap).first()
        best = dict(zip(cheap, found))
        if dear:
            best |= dict(zip(dear, maxima(read(spark, table), dear).first()))
        # over a table without a row group the count from footers is a sum of nothing, hence null
        return [(table, c, best[c], found["row_count"] or 0) for c in columns]

    rows = [Row(*row) for part in side_by_side(one, items, AUDITS_AT_A_TIME) for row in part]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)
