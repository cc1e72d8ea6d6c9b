"""Serving datasets (Q1-Q6): the app's point lookups as set-wise datasets with an optional key filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by(df: DataFrame, col: str, key) -> DataFrame:
    return df if key is None else df.filter(F.col(col) == key)


def customers(sales_view: DataFrame) -> DataFrame:
    """Q1: DISTINCT CustomerKey, FirstName, LastName, EmailAddress, AddressLine1."""
    return sales_view.select("CustomerKey", "FirstName", "LastName", "EmailAddress", "AddressLine1").distinct()


def order_history(sales: DataFrame, dates: DataFrame, customer_key=None) -> DataFrame:
    """Q2: DISTINCT (customer, order date, order number); display key quoted as "x"."""
    d = F.broadcast(dates.select(F.col("DateKey").alias("OrderDateKey"), "FullDateAlternateKey"))
    s = _by(sales, "CustomerKey", customer_key).select("CustomerKey", "OrderDateKey", "SalesOrderNumber")
    j = s.join(d, "OrderDateKey", "left")
    return j.select(F.format_string('"%s"', F.col("CustomerKey")).alias("Customer Key"),
                    F.col("FullDateAlternateKey").alias("Date"),
                    F.col("SalesOrderNumber").alias("Order Number")).distinct()


def order_lines(sales_view: DataFrame, dates: DataFrame, customer_key=None, order_number=None) -> DataFrame:
    """Q3: DISTINCT line number, order date, product name, quantity, unit price of orders."""
    d = F.broadcast(dates.select(F.col("DateKey").alias("OrderDateKey"), "FullDateAlternateKey"))
    s = _by(_by(sales_view, "CustomerKey", customer_key), "SalesOrderNumber", order_number)
    j = s.select("CustomerKey", "SalesOrderNumber", "SalesOrderLineNumber", "OrderDateKey",
                 "EnglishProductName", "OrderQuantity", "UnitPrice").join(d, "OrderDateKey", "left")
    return j.select("CustomerKey", "SalesOrderNumber", F.col("SalesOrderLineNumber").alias("Line Number"),
                    F.col("FullDateAlternateKey").alias("Date"), F.col("EnglishProductName").alias("Name"),
                    F.col("OrderQuantity").alias("Quantity"), F.col("UnitPrice").alias("Unit Price")).distinct()


def stocked_products(products: DataFrame, status: DataFrame) -> DataFrame:
    """Q4: DISTINCT (ProductKey, EnglishProductName) of products with an inventory status row."""
    return (products.select("ProductKey", "EnglishProductName")
            .join(status.select("ProductKey"), "ProductKey", "left_semi").distinct())


def inventory_lookup(status: DataFrame, product_key=None) -> DataFrame:
    """Q5: the 9 inventory columns shown for a product."""
    return _by(status, "ProductKey", product_key).select(
        "ProductKey", "UnitsBalance", "LeadTimeWeeks", "TotalForecastedDemand", "OrderQuantity",
        "HasStock", "NeedsOrder", "WeeksUntilStockAvailable", "Margin_Pct")


def picker_labels(custs: DataFrame) -> DataFrame:
    """Q6: "First Last - email" label per customer key."""
    label = F.concat(F.col("FirstName"), F.lit(" "), F.col("LastName"), F.lit(" - "), F.col("EmailAddress"))
    return custs.select("CustomerKey", label.alias("label"))
