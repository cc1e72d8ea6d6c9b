"""Canonical retail star schema bound onto the driver's TPC-H-style tables.

The operators work on a warehouse of ``fact_*`` / ``dim_*`` DataFrames with the
column contract of ``FIXTURES.md`` part A. In production those are ingested
tables (see ``sources.ingest``); here every one is a *lazy* projection of the
driver parquet, so each query's work grows with the input tables and Catalyst
prunes/pushes down through the binding into the scans.

Rules (fixed values, shared with the oracle in ``plans.oracle``):
  sales line      = lineitem JOIN orders;  order number = l_orderkey, line = l_linenumber
  money           = decimal(18,4): ExtendedAmount = l_extendedprice,
                    SalesAmount = l_extendedprice * (1 - l_discount),
                    TotalProductCost = 0.6 * l_extendedprice, Profit = SalesAmount - TotalProductCost
  category        = p_brand (anchor 'Brand#2'), subcategory = (p_brand, p_type) keyed
                    brand_no * 1e6 + ascii(type[1]) * 1e3 + ascii(type[2]);
                    no subcategory when p_partkey % 13 = 0
  model name      = p_type, NULL when p_partkey % 10 = 0
  weight          = p_size * 0.5, NULL when p_partkey % 7 = 0
  description     = NULL when p_partkey % 11 = 0
  customer attrs  = modular rules on c_custkey; YearlyIncome = (c_acctbal + 1000) * 10
  geography       = nation, territory = region; currency/employee/organization = nation
  reseller        = supplier; employee of a reseller line = l_suppkey % 25
  calendar        = 1990-01-01 .. 2030-12-31; fiscal year ends in June
  inventory       = per (part, ship month): UnitsBalance = sum(qty) % 61 - 10,
                    LeadTimeWeeks = 1 + p_partkey % 3
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import date_key, fiscal_year, money
from shelfwise.functions.derived import Derived
from shelfwise.session import size_shuffles
from shelfwise.sources.raw import read_table

# Fixed values of the binding.
ANCHOR_CATEGORY = "Brand#2"
SCORE_AS_OF = dt.date(2002, 1, 1)
CALENDAR_START = dt.date(1990, 1, 1)
CALENDAR_END = dt.date(2030, 12, 31)
NUM_NATIONS = 25
EDUCATION = ["Bachelors", "Partial College", "High School", "Graduate Degree", "Partial High School"]
COMMUTE = ["0-1 Miles", "0-1 Miles", "1-2 Miles", "1-2 Miles", "2-5 Miles", "5-10 Miles", "10+ Miles"]


# (application, folder, table) -> rows, counted from the files' footers once
_ROWS: dict[tuple[str, str, str], int] = {}
# a table of no more rows is small enough to be broadcast with its derived columns
FEW_ROWS = 100_000


def subcategory_key(brand: str, ptype: str):
    """Subcategory key from (brand, type): brand number * 1e6 + character codes of the
    type's first two letters — a row-local rule (no global numbering pass)."""
    return (F.split_part(brand, F.lit("#"), F.lit(2)).cast("int") * 1000000
            + F.ascii(ptype) * 1000 + F.ascii(F.substring(ptype, 2, 1))).cast("int")


def _pick(key, values):
    """values[key % len(values)] as a CASE chain."""
    k = key % len(values)
    expr = F.when(k == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(k == i, F.lit(v))
    return expr


class Warehouse:
    """Lazy canonical tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.sf_dir, name)
        if name == "lineitem":  # the largest table: shuffles of its rows follow their number
            size_shuffles(self.spark, self._rows(name))
        return df

    def _rows(self, name: str) -> int:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _ROWS:
            _ROWS[key] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet").count()
        return _ROWS[key]

    def few(self, name: str) -> bool:
        return self._rows(name) <= FEW_ROWS

    def made(self, table: str) -> Derived | None:
        """How a wide table is derived from the raw columns, for joins that had better move only those; None: not given."""
        return getattr(self, f"_{table}", None)

    # ---------------------------------------------------------------- facts
    def _sales(self, **keys: F.Column) -> Derived:
        """Sales lines with the given key columns after the product's; an order gives its date and what ``o_custkey`` alone does."""
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipday"),
                                            "l_quantity", "l_extendedprice", "l_discount")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderday"))
        sales = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
        cost = F.col("l_extendedprice") * F.lit(0.6)
        columns = {
            "SalesOrderNumber": F.col("l_orderkey"),
            "SalesOrderLineNumber": F.col("l_linenumber"),
            "ProductKey": F.col("l_partkey"),
            **keys,
            "CurrencyKey": (F.col("o_custkey") % NUM_NATIONS).cast("int"),
            "OrderDateKey": date_key("o_orderday"),
            "OrderDate": F.col("o_orderday"),
            "ShipDate": F.col("l_shipday"),
            "OrderQuantity": F.col("l_quantity").cast("int"),
            "UnitPrice": F.col("l_extendedprice") / F.col("l_quantity"),
            "ExtendedAmount": money("l_extendedprice"),
            "SalesAmount": money(sales),
            "TotalProductCost": money(cost),
            "Profit": (money(sales) - money(cost)).cast("decimal(18,4)"),
        }
        return Derived(lines, columns, headers=orders, on=("l_orderkey", "o_orderkey"), of_header=("CustomerKey", "CurrencyKey", "OrderDateKey", "OrderDate"))

    @cached_property
    def _fact_internet_sales(self) -> Derived:
        return self._sales(CustomerKey=F.col("o_custkey"))

    @cached_property
    def fact_internet_sales(self) -> DataFrame:
        return self._fact_internet_sales.frame()

    @cached_property
    def _fact_reseller_sales(self) -> Derived:
        return self._sales(ResellerKey=F.col("l_suppkey"), EmployeeKey=(F.col("l_suppkey") % NUM_NATIONS).cast("int"))

    @cached_property
    def fact_reseller_sales(self) -> DataFrame:
        return self._fact_reseller_sales.frame()

    @cached_property
    def fact_internet_sales_reason(self) -> DataFrame:
        l = self.raw("lineitem").select("l_orderkey", "l_linenumber")
        o = self.raw("orders").select("o_orderkey", "o_orderpriority")
        return (l.join(o, l.l_orderkey == o.o_orderkey)
                .select(F.col("l_orderkey").alias("SalesOrderNumber"),
                        F.col("l_linenumber").alias("SalesOrderLineNumber"),
                        F.substring("o_orderpriority", 1, 1).cast("int").alias("SalesReasonKey"))
                .distinct())

    @cached_property
    def fact_call_center(self) -> DataFrame:
        e = self.raw("events")
        d = F.to_date("ts")
        shift = F.when(F.hour("ts") < 12, "AM").otherwise("PM")
        g = (e.groupBy(d.alias("Date"), shift.alias("Shift"))
             .agg(F.count(F.lit(1)).alias("Calls"),
                  F.count_if(F.col("event_type") == "purchase").alias("Orders"),
                  F.count_if(F.col("event_type") == "error").alias("IssuesRaised")))
        return g.select(
            (date_key("Date").cast("bigint") * 10 + F.when(F.col("Shift") == "PM", 1).otherwise(0))
            .alias("FactCallCenterID"),
            date_key("Date").alias("DateKey"), "Shift", "Calls", "Orders", "IssuesRaised", "Date")

    @cached_property
    def fact_survey_response(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type") == "signup")
        d = F.to_date("ts")
        return e.select(F.col("event_id").alias("SurveyResponseKey"),
                        date_key(d).alias("DateKey"),
                        F.col("user_id").alias("CustomerKey"),
                        d.alias("Date"))

    @cached_property
    def fact_product_inventory(self) -> DataFrame:
        l = self.raw("lineitem")
        month_start = F.make_date(F.year("l_shipdate"), F.month("l_shipdate"), F.lit(1))
        g = l.groupBy(F.col("l_partkey").alias("ProductKey"), month_start.alias("MovementDate")) \
             .agg(F.sum("l_quantity").cast("bigint").alias("units"))
        return g.select(
            "ProductKey", date_key("MovementDate").alias("DateKey"), "MovementDate",
            ((F.col("units") % 61) - 10).cast("int").alias("UnitsBalance"),
            (F.col("ProductKey") % 3 + 1).cast("int").alias("LeadTimeWeeks"))

    @cached_property
    def fact_currency_rate(self) -> DataFrame:
        o = self.raw("orders")
        d = F.to_date("o_orderdate")
        g = o.groupBy((F.col("o_custkey") % NUM_NATIONS).cast("int").alias("CurrencyKey"), d.alias("Date")) \
             .agg(F.count(F.lit(1)).alias("OrderCount"),
                  (F.max("o_totalprice") / F.lit(100000.0)).alias("EndOfDayRate"))
        return g.select("CurrencyKey", date_key("Date").alias("DateKey"), "OrderCount", "EndOfDayRate", "Date")

    @cached_property
    def fact_finance(self) -> DataFrame:
        l = self.raw("lineitem")
        month_start = F.make_date(F.year("l_shipdate"), F.month("l_shipdate"), F.lit(1))
        keys = [(F.col("l_suppkey") % NUM_NATIONS).cast("int").alias("OrganizationKey"),
                (F.col("l_partkey") % 8 + 1).cast("int").alias("AccountKey"),
                (F.col("l_orderkey") % 4 + 1).cast("int").alias("DepartmentGroupKey"),
                month_start.alias("Date")]
        g = l.groupBy(*keys).agg(F.sum(money("l_extendedprice")).cast("double").alias("Amount"))
        fkey = (((F.col("OrganizationKey").cast("bigint") * 100 + F.col("AccountKey")) * 10
                 + F.col("DepartmentGroupKey")) * 1000000 + F.year("Date") * 100 + F.month("Date"))
        return g.select(fkey.alias("FinanceKey"), "AccountKey", "DepartmentGroupKey", "OrganizationKey",
                        date_key("Date").alias("DateKey"), "Amount", "Date")

    @cached_property
    def fact_sales_quota(self) -> DataFrame:
        r = self.fact_reseller_sales
        g = (r.groupBy("EmployeeKey",
                       F.year("OrderDate").cast("int").alias("CalendarYear"),
                       F.quarter("OrderDate").cast("int").alias("CalendarQuarter"))
             .agg(F.sum("SalesAmount").cast("double").alias("SalesAmountQuota")))
        qstart = F.make_date("CalendarYear", F.col("CalendarQuarter") * 3 - 2, F.lit(1))
        return g.select(
            ((F.col("EmployeeKey").cast("bigint") * 10000 + F.col("CalendarYear")) * 10
             + F.col("CalendarQuarter")).alias("SalesQuotaKey"),
            "EmployeeKey", date_key(qstart).alias("DateKey"), "CalendarYear", "CalendarQuarter",
            "SalesAmountQuota", qstart.alias("Date"))

    # ----------------------------------------------------------- dimensions
    @cached_property
    def dim_date(self) -> DataFrame:
        days = self.spark.range(1).select(
            F.explode(F.sequence(F.lit(CALENDAR_START), F.lit(CALENDAR_END))).alias("d"))
        d = F.col("d")
        return days.select(
            date_key(d).alias("DateKey"),
            d.alias("FullDateAlternateKey"),
            F.dayofweek(d).cast("int").alias("DayNumberOfWeek"),
            F.year(d).cast("int").alias("CalendarYear"),
            F.quarter(d).cast("int").alias("CalendarQuarter"),
            F.month(d).cast("int").alias("MonthNumberOfYear"),
            fiscal_year(d).alias("FiscalYear"),
        )

    @cached_property
    def dim_product_category(self) -> DataFrame:
        p = self.raw("part").select("p_brand").distinct()
        return p.select(F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("ProductCategoryKey"),
                        F.col("p_brand").alias("EnglishProductCategoryName"))

    @cached_property
    def dim_product_subcategory(self) -> DataFrame:
        p = self.raw("part").select("p_brand", "p_type").distinct()
        return p.select(
            subcategory_key("p_brand", "p_type").alias("ProductSubcategoryKey"),
            F.concat_ws(" ", "p_brand", "p_type").alias("EnglishProductSubcategoryName"),
            F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("ProductCategoryKey"),
            "p_brand", "p_type")

    @cached_property
    def dim_product(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        desc = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" model by "),
                        F.col("p_brand"), F.lit(", size "), F.col("p_size").cast("string"))
        return p.select(
            k.alias("ProductKey"),
            F.when(k % 13 != 0, subcategory_key("p_brand", "p_type")).alias("ProductSubcategoryKey"),
            F.col("p_name").alias("EnglishProductName"),
            F.when(k % 10 != 0, F.col("p_type")).alias("ModelName"),
            F.when(k % 11 != 0, desc).alias("EnglishDescription"),
            F.col("p_size").cast("string").alias("Size"),
            F.when(k % 7 != 0, F.col("p_size") * F.lit(0.5)).alias("Weight"),
            F.col("p_retailprice").alias("ListPrice"),
            F.substring("p_type", 1, 1).alias("ProductLine"),
            F.lit("Current").alias("Status"),
            F.lit(dt.date(1995, 1, 1)).alias("StartDate"),
            F.lit(None).cast("date").alias("EndDate"),
        )

    @cached_property
    def _dim_customer(self) -> Derived:
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment")
        k = F.col("c_custkey")
        return Derived(c, {
            "CustomerKey": k,
            "GeographyKey": F.col("c_nationkey"),
            "CustomerAlternateKey": F.concat(F.lit("AW"), F.lpad(k.cast("string"), 8, "0")),
            "FirstName": F.split_part("c_name", F.lit("#"), F.lit(1)),
            "LastName": F.split_part("c_name", F.lit("#"), F.lit(2)),
            "BirthDate": F.date_add(F.lit(dt.date(1940, 1, 1)), (k * 37 % 18000).cast("int")),
            "MaritalStatus": F.when(k % 2 == 0, "M").otherwise("S"),
            "Gender": F.when(k % 17 == 0, F.lit(None)).when(k % 5 < 2, "F").otherwise("M"),
            "EmailAddress": F.concat(F.lit("customer"), k.cast("string"), F.lit("@example.com")),
            "YearlyIncome": ((F.col("c_acctbal") + F.lit(1000.0)) * F.lit(10.0)),
            "TotalChildren": (k % 6).cast("int"),
            "NumberChildrenAtHome": (k % 3).cast("int"),
            "EnglishEducation": _pick(k, EDUCATION),
            "EnglishOccupation": F.col("c_mktsegment"),
            "HouseOwnerFlag": F.when(k % 3 == 0, "0").otherwise("1"),
            "NumberCarsOwned": (k % 5).cast("int"),
            "AddressLine1": F.concat((k % 900 + 100).cast("string"), F.lit(" Market Street")),
            "Phone": F.concat(F.lit("555-"), F.lpad((k % 10000).cast("string"), 4, "0")),
            "DateFirstPurchase": F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 365).cast("int")),
            "CommuteDistance": _pick(k, COMMUTE),
            "Title": F.when(k % 9 == 0, "Dr."),
            "MiddleName": F.substring(F.lit("ABCDEFGHIJ"), (k % 10 + 1).cast("int"), F.lit(1)),
            "NameStyle": F.lit("0"),
            "Suffix": F.when(k % 50 == 0, "Jr."),
            "SpanishEducation": F.concat(F.lit("es:"), _pick(k, EDUCATION)),
            "FrenchEducation": F.concat(F.lit("fr:"), _pick(k, EDUCATION)),
            "SpanishOccupation": F.concat(F.lit("es:"), F.col("c_mktsegment")),
            "FrenchOccupation": F.concat(F.lit("fr:"), F.col("c_mktsegment")),
            "AddressLine2": F.when(k % 8 == 0, F.concat(F.lit("Unit "), (k % 40).cast("string"))),
        }, key="c_custkey")

    @cached_property
    def dim_customer(self) -> DataFrame:
        return self._dim_customer.frame()

    @cached_property
    def dim_promotion(self) -> DataFrame:
        """One promotion per order priority, over the days of its orders."""
        o = self.raw("orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("PromotionKey"))
        return o.agg(F.to_date(F.min("o_orderdate")).alias("StartDate"), F.to_date(F.max("o_orderdate")).alias("EndDate"))

    @cached_property
    def dim_geography(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("GeographyKey"),
            F.col("n_name").alias("EnglishCountryRegionName"),
            F.col("n_regionkey").alias("SalesTerritoryKey"))

    @cached_property
    def dim_sales_territory(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").alias("SalesTerritoryKey"),
            F.col("r_name").alias("SalesTerritoryRegion"),
            F.col("r_name").alias("SalesTerritoryGroup"))

    @cached_property
    def dim_currency(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("CurrencyKey"),
            F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("CurrencyAlternateKey"),
            F.concat(F.lit("Currency of "), F.col("n_name")).alias("CurrencyName"))

    @cached_property
    def dim_employee(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        end = F.when(k % 6 == 5, F.date_add(F.lit(dt.date(2000, 1, 1)), k))
        return n.select(
            k.alias("EmployeeKey"),
            F.col("n_regionkey").alias("ParentEmployeeKey"),
            F.col("n_regionkey").alias("SalesTerritoryKey"),
            F.concat(F.lit("Rep"), k.cast("string")).alias("FirstName"),
            F.col("n_name").alias("LastName"),
            F.date_add(F.lit(dt.date(1994, 1, 1)), k * 30).alias("StartDate"),
            end.alias("EndDate"),
            F.concat(F.lit("555-01"), F.lpad(k.cast("string"), 2, "0")).alias("Phone"),
            F.when(end.isNull(), "Current").alias("Status"))

    @cached_property
    def dim_reseller(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        return s.select(
            k.alias("ResellerKey"),
            F.col("s_nationkey").alias("GeographyKey"),
            F.col("s_name").alias("ResellerName"),
            F.concat(F.lit("555-"), k.cast("string")).alias("Phone"),
            _pick(k, ["Road", "Mountain", "Touring", "Accessory"]).alias("ProductLine"))

    @cached_property
    def dim_sales_reason(self) -> DataFrame:
        o = self.raw("orders").select("o_orderpriority").distinct()
        return o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("SalesReasonKey"),
                        F.substring("o_orderpriority", 3, 100).alias("SalesReasonName"),
                        F.lit("Priority").alias("SalesReasonReasonType"))

    def _small_dim(self, n: int, key: str, name_col: str, label: str) -> DataFrame:
        return self.spark.range(1, n + 1).select(
            F.col("id").cast("int").alias(key),
            F.concat(F.lit(label + " "), F.col("id").cast("string")).alias(name_col))

    @cached_property
    def dim_account(self) -> DataFrame:
        a = self._small_dim(8, "AccountKey", "AccountDescription", "Account")
        return a.withColumn("AccountType", F.when(F.col("AccountKey") % 2 == 0, "Expenditures")
                            .otherwise("Revenue"))

    @cached_property
    def dim_department_group(self) -> DataFrame:
        return self._small_dim(4, "DepartmentGroupKey", "DepartmentGroupName", "Department group")

    @cached_property
    def dim_organization(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("OrganizationKey"),
            F.col("n_regionkey").alias("ParentOrganizationKey"),
            F.col("n_name").alias("OrganizationName"),
            F.col("n_nationkey").alias("CurrencyKey"))

    # ----------------------------------------------- inputs with no builder
    @cached_property
    def customer_summary(self) -> DataFrame:
        """Per-customer aggregate of internet sales, written once to the shared scratch folder and read by
        metrics, averages, revenue and score inputs: one scan of the fact for all of them."""
        from shelfwise.operators.customer import customer_summary, order_summary
        from shelfwise.operators.ranking import materialize
        year_ago = SCORE_AS_OF - dt.timedelta(days=365)
        return materialize(customer_summary(order_summary(self.fact_internet_sales), year_ago))

    @cached_property
    def customer_inputs(self) -> DataFrame:
        """Stand-ins for the unowned spend-prediction and purchase-probability tables, plus
        revenue (relative to ``SCORE_AS_OF``): spend = sales in the 365 days up to the as-of
        date; purchase_prob = orders / (orders + days from the last order to the as-of date);
        rev = all sales."""
        n = F.col("TotalOrders")
        prob = n / (n + F.datediff(F.lit(SCORE_AS_OF), F.col("LatestOrderDate")))
        return self.customer_summary.select(
            F.col("CustomerKey").alias("customerkey"), F.col("__recent").cast("double").alias("spend"),
            prob.alias("purchase_prob"), F.col("__amt").cast("double").alias("rev"))

    @cached_property
    def customer_spend(self) -> DataFrame:
        return self.customer_inputs.select("customerkey", "spend")

    @cached_property
    def customer_purchase(self) -> DataFrame:
        return self.customer_inputs.select("customerkey", "purchase_prob")

    @cached_property
    def bike_score_input(self) -> DataFrame:
        """Deterministic stand-in for the propensity score: NULL for anchor-category buyers."""
        s = self.fact_internet_sales.select("CustomerKey", "ProductKey")
        p = self.dim_product.select("ProductKey", "ProductSubcategoryKey")
        sc = self.dim_product_subcategory.select("ProductSubcategoryKey", "ProductCategoryKey")
        cat = self.dim_product_category
        lines = (s.join(p, "ProductKey", "left")
                 .join(sc, "ProductSubcategoryKey", "left")
                 .join(cat, "ProductCategoryKey", "left"))
        per = lines.groupBy(F.col("CustomerKey").alias("customerkey")).agg(
            F.max((F.col("EnglishProductCategoryName") == ANCHOR_CATEGORY).cast("int")).alias("buyer"),
            F.count(F.lit(1)).alias("lines"))
        score = (F.col("lines") % 10 / F.lit(10.0))
        return per.select("customerkey", F.when(F.coalesce("buyer", F.lit(0)) == 0, score)
                          .cast("float").alias("score"))


def bind(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(spark, sf_dir)
