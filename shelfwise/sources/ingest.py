"""Ingest, table maintenance and sinks.

Every write is one distributed job per table; nothing passes through the driver.
Table layouts are clustered by range-partitioning on the cluster keys and
sorting within partitions, so parquet row-group min/max statistics prune scans
on those keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from shelfwise.functions.layout import interleaved_key
from shelfwise.session import side_by_side
from shelfwise.sources import files, publish

# The source catalog — table -> cluster keys (29 tables).
SOURCE_CATALOG = {
    "DimAccount": "AccountKey,ParentAccountKey",
    "DimCurrency": "CurrencyKey",
    "DimCustomer": "CustomerKey,GeographyKey",
    "DimDate": "DateKey",
    "DimDepartmentGroup": "DepartmentGroupKey,ParentDepartmentGroupKey",
    "DimEmployee": "EmployeeKey,ParentEmployeeKey,SalesTerritoryKey",
    "DimGeography": "GeographyKey",
    "DimOrganization": "OrganizationKey,ParentOrganizationKey,CurrencyKey",
    "DimProduct": "ProductKey,ProductSubcategoryKey",
    "DimProductCategory": "ProductCategoryKey",
    "DimProductSubcategory": "ProductSubcategoryKey,ProductCategoryKey",
    "DimPromotion": "PromotionKey",
    "DimReseller": "ResellerKey,GeographyKey",
    "DimSalesReason": "SalesReasonKey",
    "DimSalesTerritory": "SalesTerritoryKey",
    "DimScenario": "ScenarioKey",
    "FactAdditionalInternationalProductDescription": "ProductKey,CultureName",
    "FactCallCenter": "FactCallCenterID,DateKey,Shift",
    "FactCurrencyRate": "CurrencyKey,DateKey",
    "FactFinance": "FinanceKey",
    "FactInternetSales": "SalesOrderNumber,SalesOrderLineNumber",
    "FactInternetSalesReason": "SalesOrderNumber,SalesOrderLineNumber,SalesReasonKey",
    "FactProductInventory": "ProductKey,DateKey",
    "FactResellerSales": "SalesOrderNumber,SalesOrderLineNumber",
    "FactSalesQuota": "SalesQuotaKey",
    "FactSurveyResponse": "SurveyResponseKey",
    "NewFactCurrencyRate": "CurrencyKey,DateKey",
    "ProspectiveBuyer": "ProspectiveBuyerKey",
    "sysdiagrams": "name,principal_id,diagram_id",
}


# tables written at the same time by ``ingest``
WRITES_AT_A_TIME = 4


# Fixed rule: table names in the target catalog.
def snake_name(name: str) -> str:
    """CamelCase -> snake_case: an underscore between a lowercase and an uppercase letter, then lower.
    Runs of capitals are not split (``NewFactCurrencyRate`` -> ``new_fact_currency_rate``)."""
    return re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()


class Split(NamedTuple):
    """How one table's JDBC read is split: ``parts`` range queries over ``column`` between the bounds."""

    column: str
    lower: int
    upper: int
    parts: int


def jdbc_options(url: str, table: str, properties: dict[str, str], split: Split | None = None) -> dict[str, str]:
    """Reader options of one table; without a split it is read over one connection."""
    options = {"url": url, "dbtable": table, **properties}
    if split:
        options |= {"partitionColumn": split.column, "lowerBound": str(split.lower), "upperBound": str(split.upper),
                    "numPartitions": str(split.parts)}
    return options


def jdbc_reader(spark: SparkSession, url: str, properties: dict[str, str],
                splits: dict[str, Split] | None = None) -> Callable[[str], DataFrame]:
    """JDBC table reader; every table has its own split (``splits`` by table name)."""
    def read(table: str) -> DataFrame:
        return spark.read.format("jdbc").options(**jdbc_options(url, table, properties, (splits or {}).get(table))).load()
    return read


def cluster(df: DataFrame, cols: list[str], num_partitions: int | None = None, interleaved: bool = False) -> DataFrame:
    """Range-partition by the cluster keys and sort inside partitions (S5 layout).

    In the order of the keys, which serves filters on the first of them; ``interleaved``: in the order of all keys'
    bits in turns, which serves filters on any of them. There a hash of the row cuts ranges inside a value that
    many rows share. Without ``num_partitions`` the session and adaptive execution size the ranges.
    """
    parts = [num_partitions] if num_partitions else []
    if interleaved:
        keyed = df.withColumn("__layout", interleaved_key(df, cols))
        order = ["__layout", *cols]
        return keyed.repartitionByRange(*parts, *order, F.xxhash64(*df.columns)).sortWithinPartitions(*order).drop("__layout")
    return df.repartitionByRange(*parts, *cols).sortWithinPartitions(*cols)


def write_clustered(df: DataFrame, cols: list[str], path: str, mode: str = "overwrite",
                    num_partitions: int | None = None, interleaved: bool = False) -> None:
    """Clustered write to a plain folder. Overwriting a folder that exists writes aside first, so a failing job leaves
    the old rows; the new files carry the new schema. Tables with readers are replaced by ``publish_clustered``."""
    out = cluster(df, cols, num_partitions, interleaved)
    if mode == "overwrite" and files.exists(df.sparkSession, path):
        publish.swap_folder(out, path)
    else:
        out.write.mode(mode).parquet(path)


def publish_clustered(df: DataFrame, cols: list[str], root: str, num_partitions: int | None = None,
                      keep: int = publish.KEEP, interleaved: bool = False) -> str:
    """Clustered write of a new version of the table under ``root``, made current in one step (``publish``)."""
    return publish.publish(cluster(df, cols, num_partitions, interleaved), root, keep)


def replace_table(df: DataFrame, table: str, cluster_cols: list[str] | None = None,
                  num_partitions: int | None = None) -> None:
    """Replace a catalog table with the result of a query (the drop + CTAS pair without a window where the
    table is missing or half written); the new version takes the query's schema. Optionally range-clustered on ``cluster_cols``."""
    publish.replace(cluster(df, cluster_cols, num_partitions) if cluster_cols else df, table)


def append_table(df: DataFrame, table: str) -> None:
    """Append rows to an existing catalog table by column name (INSERT INTO t (cols) ...)."""
    publish.append(df, table)


def reconcile(items: Iterable[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(table, pre_count, post_count) — counts before and after a row filter in one pass per table."""
    rows = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("pre_count"),
                   F.count_if(F.coalesce(pred, F.lit(False))).alias("post_count"))
            for name, df, pred in items]
    return reduce(DataFrame.unionByName, rows)


def add_profit(df: DataFrame, after: str = "SalesAmount") -> DataFrame:
    """Profit = SalesAmount - TotalProductCost, placed right after ``after``."""
    st = df.schema["SalesAmount"].dataType
    profit = F.col("SalesAmount") - F.col("TotalProductCost")
    profit = profit.cast(st) if isinstance(st, DecimalType) else profit.cast("double")
    cols = []
    for c in df.columns:
        cols.append(F.col(c))
        if c == after:
            cols.append(profit.alias("Profit"))
    return df.select(*cols)


def shift_dates(df: DataFrame, cols: list[str], months: int, cutoff: str | None = None,
                cutoff_col: str | None = None, keep_null: bool = True) -> DataFrame:
    """Move date columns forward by ``months``; optionally keep rows with
    ``cutoff_col < cutoff`` (NULL kept when ``keep_null``)."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.add_months(F.col(c), months))
    if cutoff is not None and cutoff_col is not None:
        cond = F.col(cutoff_col) < F.to_date(F.lit(cutoff))
        if keep_null:
            cond = cond | F.col(cutoff_col).isNull()
        out = out.filter(cond)
    return out


class Shift(NamedTuple):
    """Date columns moved by months, year columns by years, and the cutoff columns all of which must pass."""

    dates: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    before_or_null: tuple[str, ...] = ()


# How far dates move, the cutoff, and each table's columns.
SHIFT_MONTHS, SHIFT_YEARS, SHIFT_CUTOFF = 132, 11, "2024-04-30"
_PERIOD = Shift(("StartDate", "EndDate"), before=("StartDate",), before_or_null=("EndDate",))
_DAY = Shift(("Date",), before=("Date",))
_SALES = Shift(("OrderDate", "DueDate", "ShipDate"), before=("OrderDate", "ShipDate"))
TABLE_SHIFTS = {
    "DimCustomer": Shift(("BirthDate", "DateFirstPurchase"), before=("DateFirstPurchase",)),
    "DimDate": Shift(("FullDateAlternateKey",), ("CalendarYear", "FiscalYear")),
    "DimEmployee": _PERIOD._replace(dates=("BirthDate", "HireDate", "StartDate", "EndDate")),
    "DimProduct": _PERIOD,
    "DimPromotion": _PERIOD,
    "DimReseller": Shift(years=("FirstOrderYear", "LastOrderYear", "YearOpened")),
    "FactCallCenter": Shift(("Date",)),
    "FactCurrencyRate": _DAY,
    "FactFinance": _DAY,
    "FactInternetSales": _SALES,
    "FactProductInventory": Shift(("MovementDate",), before=("MovementDate",)),
    "FactResellerSales": _SALES,
    "FactSalesQuota": _DAY,
    "FactSurveyResponse": _DAY,
    "NewFactCurrencyRate": Shift(("CurrencyDate",), before=("CurrencyDate",)),
    "ProspectiveBuyer": Shift(("BirthDate",)),
}


def shift_table(df: DataFrame, table: str, months: int = SHIFT_MONTHS, years: int = SHIFT_YEARS,
                cutoff: str = SHIFT_CUTOFF) -> DataFrame:
    """S7 by the table's configuration: move its date and year columns (those that ``df`` has), then keep rows whose
    moved dates lie before the cutoff in every cutoff column. Tables without a configuration stay as they are."""
    spec = TABLE_SHIFTS.get(table, Shift())
    have = set(df.columns)
    moved = {c: F.add_months(c, months) for c in spec.dates if c in have} | {c: F.col(c) + years for c in spec.years if c in have}
    out = df.withColumns(moved) if moved else df
    end = F.to_date(F.lit(cutoff))
    for c in spec.before:
        out = out.where(F.col(c) < end) if c in have else out
    for c in spec.before_or_null:
        out = out.where((F.col(c) < end) | F.col(c).isNull()) if c in have else out
    return out


def freshness(items: Iterable[tuple[str, str, DataFrame]]) -> DataFrame:
    """(table, column, max value as string) stacked for several tables."""
    rows = [df.agg(F.lit(t).alias("table"), F.lit(c).alias("column"),
                   F.max(F.col(c)).cast("string").alias("max_value"))
            for t, c, df in items]
    return reduce(DataFrame.unionByName, rows)


def ingest(spark: SparkSession, read: Callable[[str], DataFrame], root: str,
           catalog: dict[str, str] = SOURCE_CATALOG,
           transform: Callable[[str, DataFrame], DataFrame] | None = None,
           pred: Callable[[str], Column | None] | None = None, versioned: bool = False) -> DataFrame:
    """S2 (+S4, S5): read every catalog table, optionally transform it, write it clustered
    under ``root/<snake_name>``; returns the reconciliation rows (table, pre, post).

    ``versioned`` publishes each table as a new version (read it with ``publish.read_published``): ingesting again
    replaces the tables one by one, each in one step; else the folders are plain.
    """
    def one(item: tuple[str, str]) -> tuple[str, DataFrame, Column]:
        table, keys = item
        src = read(table)
        out = transform(table, src) if transform else src
        (publish_clustered if versioned else write_clustered)(out, keys.split(","), f"{root}/{snake_name(table)}")
        p = pred(table) if pred else None
        return snake_name(table), src, p if p is not None else F.lit(True)

    # every write is a distributed job; a few run at a time so that small tables do not wait for large ones
    return reconcile(side_by_side(one, catalog.items(), WRITES_AT_A_TIME))


def verify_roundtrip(spark: SparkSession, read: Callable[[str], DataFrame], root: str,
                     catalog: dict[str, str], versioned: bool = False) -> DataFrame:
    """(table, source_rows, written_rows, same_content): each source against its written copy (``versioned``: the current version).

    ``same_content`` compares order-independent sums of row hashes, so a row lost, repeated or changed shows.
    """
    def sums(df: DataFrame, rows: str, content: str) -> DataFrame:
        row_hash = F.xxhash64(*df.columns).cast("decimal(38,0)")
        return df.agg(F.count(F.lit(1)).alias(rows), F.coalesce(F.sum(row_hash), F.lit(0)).alias(content))

    parts = []
    for table in catalog:
        src = sums(read(table), "source_rows", "source_content")
        at = f"{root}/{snake_name(table)}"
        dst = sums(publish.read_published(spark, at) if versioned else spark.read.parquet(at), "written_rows", "written_content")
        parts.append(src.crossJoin(dst).select(F.lit(snake_name(table)).alias("table"), "source_rows", "written_rows",
                                               (F.col("source_content") == F.col("written_content")).alias("same_content")))
    return reduce(DataFrame.unionByName, parts)


def append_returns(returns: DataFrame, sales: DataFrame, path: str, validate: bool = True, batch: str | None = None) -> DataFrame:
    """Append (OrderNumber, LineNumber) rows to the returns table as one job; returns the rows as they are stored.

    With ``validate`` only lines that exist in ``sales`` are appended (left-semi join). With a ``batch`` key the rows get a folder
    of their own, ``batch=<key>``, that a second run with this key replaces: running again repeats nothing, lines of other batches are
    left out, and the table has a column ``batch``. Without a key every run appends.
    """
    spark = returns.sparkSession
    r = returns.select(F.col("OrderNumber"), F.col("LineNumber"))
    if validate:
        keys = sales.select(F.col("SalesOrderNumber").alias("OrderNumber"),
                            F.col("SalesOrderLineNumber").alias("LineNumber"))
        r = r.join(keys, ["OrderNumber", "LineNumber"], "left_semi")
    if batch is None:
        r.write.mode("append").parquet(path)
        return r
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch key is made of letters, digits, '_', '.' and '-'")
    folder = f"{path.rstrip('/')}/batch={batch}"
    if files.names(spark, path):
        other = spark.read.schema("OrderNumber long, LineNumber int, batch string").parquet(path).where(F.col("batch") != batch)
        r = r.join(other, ["OrderNumber", "LineNumber"], "left_anti")
    r = r.distinct()
    if files.exists(spark, folder):
        publish.swap_folder(r, folder)
    else:
        r.write.parquet(folder)
    return spark.read.schema(r.schema).parquet(folder)


def json_export(df: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON document per row (NULL fields omitted); written as JSON lines if ``path``."""
    out = df.select(F.to_json(F.struct(*df.columns)).alias("json"))
    if path:
        df.write.mode("overwrite").json(path)
    return out
