"""Data-mining views over internet sales (M1-M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_floor_years, income_group, mapped

# The reference's bike model list and predecessor -> successor codes.
DEFAULT_MODELS = ["Mountain-100", "Mountain-200", "Road-150", "Road-250",
                  "Road-650", "Road-750", "Touring-1000"]
DEFAULT_SUCCESSOR_CODES = {"Mountain-100": "M200", "Road-150": "R250",
                           "Road-650": "R750", "Touring-1000": "T1000"}
DEFAULT_AS_OF = "2002-01-01"


def dm_prep(w, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """M1: sales INNER JOIN date, product, subcategory, category, customer, geography, territory.

    Only the calendar (bounded by construction) is broadcast explicitly; the planner
    sizes the other joins (broadcast under the threshold, sort-merge beyond it).
    """
    f = w.fact_internet_sales.select("OrderDateKey", "ProductKey", "CustomerKey", "SalesOrderNumber",
                                     "SalesOrderLineNumber", "OrderQuantity", "ExtendedAmount")
    d = F.broadcast(w.dim_date.select(F.col("DateKey").alias("OrderDateKey"), "CalendarYear",
                                      "FiscalYear", "MonthNumberOfYear"))
    p = w.dim_product.select("ProductKey", "ProductSubcategoryKey", "ModelName", "EnglishProductName")
    sc = w.dim_product_subcategory.select("ProductSubcategoryKey", "ProductCategoryKey")
    pc = w.dim_product_category.select("ProductCategoryKey", "EnglishProductCategoryName")
    c = w.dim_customer.select("CustomerKey", "GeographyKey", "BirthDate", "YearlyIncome")
    g = w.dim_geography.select("GeographyKey", "SalesTerritoryKey")
    s = w.dim_sales_territory.select("SalesTerritoryKey", "SalesTerritoryGroup")
    j = (f.join(d, "OrderDateKey").join(p, "ProductKey").join(sc, "ProductSubcategoryKey")
          .join(pc, "ProductCategoryKey").join(c, "CustomerKey").join(g, "GeographyKey")
          .join(s, "SalesTerritoryKey"))
    return j.select(
        "EnglishProductCategoryName",
        F.coalesce("ModelName", "EnglishProductName").alias("Model"),
        "CustomerKey",
        F.col("SalesTerritoryGroup").alias("Region"),
        age_floor_years("BirthDate", as_of).alias("Age"),
        income_group("YearlyIncome").alias("IncomeGroup"),
        "CalendarYear", "FiscalYear",
        F.col("MonthNumberOfYear").alias("Month"),
        F.col("SalesOrderNumber").alias("OrderNumber"),
        F.col("SalesOrderLineNumber").alias("LineNumber"),
        F.col("OrderQuantity").alias("Quantity"),
        F.col("ExtendedAmount").alias("Amount"))


def null_violations(prep: DataFrame) -> DataFrame:
    """M2: prepared rows whose Model or Region is NULL (should be empty)."""
    return prep.filter(F.col("Model").isNull() | F.col("Region").isNull())


def assoc_line_items(prep: DataFrame, fiscal_year: int) -> DataFrame:
    """M3: (OrderNumber, LineNumber, Model) for one fiscal year."""
    return prep.filter(F.col("FiscalYear") == fiscal_year).select("OrderNumber", "LineNumber", "Model")


def assoc_orders(prep: DataFrame, fiscal_year: int) -> DataFrame:
    """M4: DISTINCT (OrderNumber, CustomerKey, Region, IncomeGroup) for one fiscal year."""
    return (prep.filter(F.col("FiscalYear") == fiscal_year)
            .select("OrderNumber", "CustomerKey", "Region", "IncomeGroup").distinct())


# The 29 customer attributes of the target-mail view.
TARGET_MAIL_ATTRIBUTES = [
    "CustomerKey", "GeographyKey", "CustomerAlternateKey", "Title", "FirstName", "MiddleName", "LastName", "NameStyle",
    "BirthDate", "MaritalStatus", "Suffix", "Gender", "EmailAddress", "YearlyIncome", "TotalChildren",
    "NumberChildrenAtHome", "EnglishEducation", "SpanishEducation", "FrenchEducation", "EnglishOccupation",
    "SpanishOccupation", "FrenchOccupation", "HouseOwnerFlag", "NumberCarsOwned", "AddressLine1", "AddressLine2",
    "Phone", "DateFirstPurchase", "CommuteDistance"]


def target_mail(prep: DataFrame, customers: DataFrame, anchor: str) -> DataFrame:
    """M5: customer attributes + Region, Age, BikeBuyer (1 if any anchor-category line)."""
    x = prep.groupBy("CustomerKey", "Region", "Age").agg(
        F.sum(F.when(F.col("EnglishProductCategoryName") == anchor, 1).otherwise(0)).alias("Bikes"))
    j = customers.join(x, "CustomerKey", "inner")
    return j.select(*TARGET_MAIL_ATTRIBUTES, "Region", "Age",
                    F.when(F.col("Bikes") == 0, 0).otherwise(1).alias("BikeBuyer"))


def model_code(model, successor: dict[str, str]):
    """Successor code if listed, else first char + last three chars."""
    default = F.concat(F.left(model, F.lit(1)), F.right(model, F.lit(3)))
    return mapped(model, successor, default) if successor else default


def time_series(prep: DataFrame, models: list[str] = DEFAULT_MODELS,
                successor: dict[str, str] = DEFAULT_SUCCESSOR_CODES) -> DataFrame:
    """M6: monthly Quantity/Amount per (model code, region) for the listed models."""
    src = prep.filter(F.col("Model").isin(models))
    keyed = src.select(
        F.concat(model_code(F.col("Model"), successor), F.lit(" "), F.col("Region")).alias("ModelRegion"),
        (F.col("CalendarYear").cast("int") * 100 + F.col("Month").cast("int")).alias("TimeIndex"),
        "CalendarYear", "Month", "Quantity", "Amount")
    agg = keyed.groupBy("ModelRegion", "TimeIndex", "CalendarYear", "Month").agg(
        F.sum("Quantity").alias("Quantity"), F.sum("Amount").alias("Amount"))
    return agg.select("ModelRegion", "TimeIndex", "Quantity", "Amount", "CalendarYear", "Month",
                      F.make_date("CalendarYear", "Month", F.lit(25)).alias("ReportingDate"))
