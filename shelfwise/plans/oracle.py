"""Independent DuckDB statements of every comparable query (the correctness oracle).

Written against the raw driver tables only: ``BINDING`` re-states the canonical
star schema of ``sources.binding`` as CTEs, and each query body re-states its
operator in plain SQL (global windows, NOT EXISTS, self joins — the direct
forms the Spark side deliberately avoids). Spark rounds doubles HALF_UP /
HALF_EVEN on their decimal text, reproduced here through a VARCHAR -> DECIMAL cast.
"""

from __future__ import annotations

from shelfwise.operators import mining, propensity
from shelfwise.operators.propensity import CATEGORICAL, NUMERIC
from shelfwise.operators.text import KEYWORD_INSTRUCTION, RECAP_INSTRUCTION, STOP_WORDS
from shelfwise.plans import catalog as C
from shelfwise.sources.binding import EDUCATION


def sround(x: str, d: int) -> str:
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def sbround(x: str, d: int) -> str:
    return f"CAST(round_even(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DK = "CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS INTEGER)"


def dk(d: str) -> str:
    return DK.format(d=d)


BINDING = f"""
sales_lines AS (
  SELECT l.l_orderkey AS SalesOrderNumber, l.l_linenumber AS SalesOrderLineNumber, l.l_partkey AS ProductKey,
         o.o_custkey, l.l_suppkey,
         {dk('CAST(o.o_orderdate AS DATE)')} AS OrderDateKey, CAST(o.o_orderdate AS DATE) AS OrderDate,
         CAST(l.l_shipdate AS DATE) AS ShipDate, CAST(l.l_quantity AS INTEGER) AS OrderQuantity,
         l.l_extendedprice / l.l_quantity AS UnitPrice,
         CAST(l.l_extendedprice AS DECIMAL(18,4)) AS ExtendedAmount,
         CAST(l.l_extendedprice * (1.0::DOUBLE - l.l_discount) AS DECIMAL(18,4)) AS SalesAmount,
         CAST(l.l_extendedprice * 0.6::DOUBLE AS DECIMAL(18,4)) AS TotalProductCost,
         CAST(CAST(l.l_extendedprice * (1.0::DOUBLE - l.l_discount) AS DECIMAL(18,4))
              - CAST(l.l_extendedprice * 0.6::DOUBLE AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS Profit
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
fact_internet_sales AS (
  SELECT SalesOrderNumber, SalesOrderLineNumber, ProductKey, o_custkey AS CustomerKey,
         CAST(o_custkey % 25 AS INTEGER) AS CurrencyKey, OrderDateKey, OrderDate, ShipDate, OrderQuantity,
         UnitPrice, ExtendedAmount, SalesAmount, TotalProductCost, Profit FROM sales_lines),
fact_reseller_sales AS (
  SELECT SalesOrderNumber, SalesOrderLineNumber, ProductKey, l_suppkey AS ResellerKey,
         CAST(l_suppkey % 25 AS INTEGER) AS EmployeeKey, CAST(o_custkey % 25 AS INTEGER) AS CurrencyKey,
         OrderDateKey, OrderDate, ShipDate, OrderQuantity, UnitPrice, ExtendedAmount, SalesAmount,
         TotalProductCost, Profit FROM sales_lines),
fact_internet_sales_reason AS (
  SELECT DISTINCT l.l_orderkey AS SalesOrderNumber, l.l_linenumber AS SalesOrderLineNumber,
         CAST(substring(o.o_orderpriority, 1, 1) AS INTEGER) AS SalesReasonKey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
fact_call_center AS (
  SELECT CAST({dk('d')} AS BIGINT) * 10 + CASE WHEN Shift = 'PM' THEN 1 ELSE 0 END AS FactCallCenterID,
         {dk('d')} AS DateKey, Shift, Calls, Orders, IssuesRaised, d AS Date
  FROM (SELECT CAST(ts AS DATE) AS d, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS Shift,
               count(*) AS Calls, count_if(event_type = 'purchase') AS Orders,
               count_if(event_type = 'error') AS IssuesRaised
        FROM events GROUP BY 1, 2)),
fact_survey_response AS (
  SELECT event_id AS SurveyResponseKey, {dk('CAST(ts AS DATE)')} AS DateKey, user_id AS CustomerKey,
         CAST(ts AS DATE) AS Date FROM events WHERE event_type = 'signup'),
fact_product_inventory AS (
  SELECT ProductKey, {dk('MovementDate')} AS DateKey, MovementDate,
         CAST(units % 61 - 10 AS INTEGER) AS UnitsBalance, CAST(ProductKey % 3 + 1 AS INTEGER) AS LeadTimeWeeks
  FROM (SELECT l_partkey AS ProductKey, make_date(year(l_shipdate), month(l_shipdate), 1) AS MovementDate,
               CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY 1, 2)),
fact_currency_rate AS (
  SELECT CurrencyKey, {dk('Date')} AS DateKey, OrderCount, EndOfDayRate, Date
  FROM (SELECT CAST(o_custkey % 25 AS INTEGER) AS CurrencyKey, CAST(o_orderdate AS DATE) AS Date,
               count(*) AS OrderCount, max(o_totalprice) / 100000.0::DOUBLE AS EndOfDayRate
        FROM orders GROUP BY 1, 2)),
fact_finance AS (
  SELECT ((CAST(OrganizationKey AS BIGINT) * 100 + AccountKey) * 10 + DepartmentGroupKey) * 1000000
           + year(Date) * 100 + month(Date) AS FinanceKey,
         AccountKey, DepartmentGroupKey, OrganizationKey, {dk('Date')} AS DateKey, Amount, Date
  FROM (SELECT CAST(l_suppkey % 25 AS INTEGER) AS OrganizationKey, CAST(l_partkey % 8 + 1 AS INTEGER) AS AccountKey,
               CAST(l_orderkey % 4 + 1 AS INTEGER) AS DepartmentGroupKey,
               make_date(year(l_shipdate), month(l_shipdate), 1) AS Date,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS Amount
        FROM lineitem GROUP BY 1, 2, 3, 4)),
fact_sales_quota AS (
  SELECT (CAST(EmployeeKey AS BIGINT) * 10000 + CalendarYear) * 10 + CalendarQuarter AS SalesQuotaKey,
         EmployeeKey, {dk('make_date(CalendarYear, CalendarQuarter * 3 - 2, 1)')} AS DateKey,
         CalendarYear, CalendarQuarter, SalesAmountQuota, make_date(CalendarYear, CalendarQuarter * 3 - 2, 1) AS Date
  FROM (SELECT EmployeeKey, CAST(year(OrderDate) AS INTEGER) AS CalendarYear,
               CAST(quarter(OrderDate) AS INTEGER) AS CalendarQuarter,
               CAST(sum(SalesAmount) AS DOUBLE) AS SalesAmountQuota
        FROM fact_reseller_sales GROUP BY 1, 2, 3)),
dim_date AS (
  SELECT {dk('d')} AS DateKey, d AS FullDateAlternateKey, CAST(dayofweek(d) + 1 AS INTEGER) AS DayNumberOfWeek,
         CAST(year(d) AS INTEGER) AS CalendarYear, CAST(quarter(d) AS INTEGER) AS CalendarQuarter,
         CAST(month(d) AS INTEGER) AS MonthNumberOfYear,
         CAST(year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS FiscalYear
  FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)),
dim_product_category AS (
  SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS ProductCategoryKey,
         p_brand AS EnglishProductCategoryName FROM part),
dim_product_subcategory AS (
  SELECT CAST(CAST(split_part(p_brand, '#', 2) AS INTEGER) * 1000000 + ascii(p_type) * 1000
              + ascii(substring(p_type, 2, 1)) AS INTEGER) AS ProductSubcategoryKey,
         concat_ws(' ', p_brand, p_type) AS EnglishProductSubcategoryName,
         CAST(split_part(p_brand, '#', 2) AS INTEGER) AS ProductCategoryKey, p_brand, p_type
  FROM (SELECT DISTINCT p_brand, p_type FROM part)),
dim_product AS (
  SELECT p.p_partkey AS ProductKey,
         CASE WHEN p.p_partkey % 13 <> 0 THEN CAST(CAST(split_part(p.p_brand, '#', 2) AS INTEGER) * 1000000
              + ascii(p.p_type) * 1000 + ascii(substring(p.p_type, 2, 1)) AS INTEGER) END AS ProductSubcategoryKey,
         p.p_name AS EnglishProductName,
         CASE WHEN p.p_partkey % 10 <> 0 THEN p.p_type END AS ModelName,
         CASE WHEN p.p_partkey % 11 <> 0 THEN p.p_name || ' ' || lower(p.p_type) || ' model by ' || p.p_brand
              || ', size ' || CAST(p.p_size AS VARCHAR) END AS EnglishDescription,
         CAST(p.p_size AS VARCHAR) AS Size,
         CASE WHEN p.p_partkey % 7 <> 0 THEN p.p_size * 0.5::DOUBLE END AS Weight,
         p.p_retailprice AS ListPrice, substring(p.p_type, 1, 1) AS ProductLine, 'Current' AS Status,
         DATE '1995-01-01' AS StartDate, CAST(NULL AS DATE) AS EndDate
  FROM part p),
dim_customer AS (
  SELECT c_custkey AS CustomerKey, c_nationkey AS GeographyKey,
         'AW' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS CustomerAlternateKey,
         split_part(c_name, '#', 1) AS FirstName, split_part(c_name, '#', 2) AS LastName,
         DATE '1940-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS BirthDate,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'S' END AS MaritalStatus,
         CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 < 2 THEN 'F' ELSE 'M' END AS Gender,
         'customer' || CAST(c_custkey AS VARCHAR) || '@example.com' AS EmailAddress,
         (c_acctbal + 1000.0::DOUBLE) * 10.0::DOUBLE AS YearlyIncome,
         CAST(c_custkey % 6 AS INTEGER) AS TotalChildren, CAST(c_custkey % 3 AS INTEGER) AS NumberChildrenAtHome,
         CASE c_custkey % 5 WHEN 0 THEN 'Bachelors' WHEN 1 THEN 'Partial College' WHEN 2 THEN 'High School'
              WHEN 3 THEN 'Graduate Degree' WHEN 4 THEN 'Partial High School' END AS EnglishEducation,
         c_mktsegment AS EnglishOccupation,
         CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '1' END AS HouseOwnerFlag,
         CAST(c_custkey % 5 AS INTEGER) AS NumberCarsOwned,
         CAST(c_custkey % 900 + 100 AS VARCHAR) || ' Market Street' AS AddressLine1,
         '555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS Phone,
         DATE '1995-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DateFirstPurchase,
         CASE WHEN c_custkey % 9 = 0 THEN 'Dr.' END AS Title, substring('ABCDEFGHIJ', c_custkey % 10 + 1, 1) AS MiddleName,
         '0' AS NameStyle, CASE WHEN c_custkey % 50 = 0 THEN 'Jr.' END AS Suffix,
         'es:' || list_extract({list(EDUCATION)}, c_custkey % 5 + 1) AS SpanishEducation,
         'fr:' || list_extract({list(EDUCATION)}, c_custkey % 5 + 1) AS FrenchEducation,
         'es:' || c_mktsegment AS SpanishOccupation, 'fr:' || c_mktsegment AS FrenchOccupation,
         CASE WHEN c_custkey % 8 = 0 THEN 'Unit ' || CAST(c_custkey % 40 AS VARCHAR) END AS AddressLine2,
         CASE c_custkey % 7 WHEN 0 THEN '0-1 Miles' WHEN 1 THEN '0-1 Miles' WHEN 2 THEN '1-2 Miles'
              WHEN 3 THEN '1-2 Miles' WHEN 4 THEN '2-5 Miles' WHEN 5 THEN '5-10 Miles'
              WHEN 6 THEN '10+ Miles' END AS CommuteDistance
  FROM customer),
dim_promotion AS (
  SELECT CAST(left(o_orderpriority, 1) AS INTEGER) AS PromotionKey, CAST(min(o_orderdate) AS DATE) AS StartDate,
         CAST(max(o_orderdate) AS DATE) AS EndDate FROM orders GROUP BY 1),
dim_geography AS (SELECT n_nationkey AS GeographyKey, n_name AS EnglishCountryRegionName,
                         n_regionkey AS SalesTerritoryKey FROM nation),
dim_sales_territory AS (SELECT r_regionkey AS SalesTerritoryKey, r_name AS SalesTerritoryRegion,
                               r_name AS SalesTerritoryGroup FROM region),
dim_currency AS (SELECT n_nationkey AS CurrencyKey, 'C' || CAST(n_nationkey AS VARCHAR) AS CurrencyAlternateKey,
                        'Currency of ' || n_name AS CurrencyName FROM nation),
dim_employee AS (
  SELECT n_nationkey AS EmployeeKey, n_regionkey AS ParentEmployeeKey, n_regionkey AS SalesTerritoryKey,
         'Rep' || CAST(n_nationkey AS VARCHAR) AS FirstName, n_name AS LastName,
         DATE '1994-01-01' + n_nationkey * 30 AS StartDate,
         CASE WHEN n_nationkey % 6 = 5 THEN DATE '2000-01-01' + n_nationkey END AS EndDate,
         '555-01' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS Phone,
         CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 'Current' END AS Status
  FROM nation),
dim_reseller AS (
  SELECT s_suppkey AS ResellerKey, s_nationkey AS GeographyKey, s_name AS ResellerName,
         '555-' || CAST(s_suppkey AS VARCHAR) AS Phone,
         CASE s_suppkey % 4 WHEN 0 THEN 'Road' WHEN 1 THEN 'Mountain' WHEN 2 THEN 'Touring'
              WHEN 3 THEN 'Accessory' END AS ProductLine
  FROM supplier),
dim_sales_reason AS (
  SELECT DISTINCT CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS SalesReasonKey,
         substring(o_orderpriority, 3, 100) AS SalesReasonName, 'Priority' AS SalesReasonReasonType FROM orders),
dim_account AS (SELECT CAST(i AS INTEGER) AS AccountKey, 'Account ' || CAST(i AS VARCHAR) AS AccountDescription,
                       CASE WHEN i % 2 = 0 THEN 'Expenditures' ELSE 'Revenue' END AS AccountType
                FROM range(1, 9) t(i)),
dim_department_group AS (SELECT CAST(i AS INTEGER) AS DepartmentGroupKey,
                                'Department group ' || CAST(i AS VARCHAR) AS DepartmentGroupName
                         FROM range(1, 5) t(i)),
dim_organization AS (SELECT n_nationkey AS OrganizationKey, n_regionkey AS ParentOrganizationKey,
                            n_name AS OrganizationName, n_nationkey AS CurrencyKey FROM nation),
customer_spend AS (
  SELECT CustomerKey AS customerkey,
         CAST(sum(CASE WHEN OrderDate > DATE '{C.AS_OF}' - 365 THEN SalesAmount END) AS DOUBLE) AS spend
  FROM fact_internet_sales GROUP BY 1),
customer_purchase AS (
  SELECT CustomerKey AS customerkey,
         count(DISTINCT SalesOrderNumber) / (count(DISTINCT SalesOrderNumber)
           + date_diff('day', max(OrderDate), DATE '{C.AS_OF}')) AS purchase_prob
  FROM fact_internet_sales GROUP BY 1),
bike_score_input AS (
  SELECT f.CustomerKey AS customerkey,
         CASE WHEN coalesce(max(CAST(c.EnglishProductCategoryName = {_q(C.ANCHOR_CATEGORY)} AS INTEGER)), 0) = 0
              THEN CAST((count(*) % 10) / 10.0::DOUBLE AS FLOAT) END AS score
  FROM fact_internet_sales f LEFT JOIN dim_product p ON f.ProductKey = p.ProductKey
  LEFT JOIN dim_product_subcategory s ON p.ProductSubcategoryKey = s.ProductSubcategoryKey
  LEFT JOIN dim_product_category c ON s.ProductCategoryKey = c.ProductCategoryKey
  GROUP BY 1),
order_day AS (SELECT DateKey AS OrderDateKey, * EXCLUDE (DateKey) FROM dim_date),
currency_label AS (SELECT CurrencyKey, CurrencyName FROM dim_currency),
subcategory_path AS (
  SELECT ProductSubcategoryKey, EnglishProductSubcategoryName, EnglishProductCategoryName
  FROM dim_product_subcategory LEFT JOIN dim_product_category USING (ProductCategoryKey)),
product_path AS (SELECT * FROM dim_product LEFT JOIN subcategory_path USING (ProductSubcategoryKey)),
seller AS (
  SELECT EmployeeKey, ParentEmployeeKey, FirstName, LastName, StartDate AS EmpStartDate, EndDate AS EmpEndDate,
         Phone AS EmpPhone, SalesTerritoryKey AS EmpSalesTerritoryKey, Status AS EmpStatus FROM dim_employee),
outlet AS (SELECT ResellerKey, GeographyKey, ResellerName, Phone, ProductLine AS ResellerProductLine FROM dim_reseller),
v_fact_internet_sales AS (
  SELECT * FROM fact_internet_sales
  LEFT JOIN product_path USING (ProductKey) LEFT JOIN dim_customer USING (CustomerKey)
  LEFT JOIN order_day USING (OrderDateKey) LEFT JOIN currency_label USING (CurrencyKey)),
v_fact_reseller_sales AS (
  SELECT * FROM fact_reseller_sales
  LEFT JOIN outlet USING (ResellerKey) LEFT JOIN product_path USING (ProductKey) LEFT JOIN seller USING (EmployeeKey)
  LEFT JOIN order_day USING (OrderDateKey) LEFT JOIN currency_label USING (CurrencyKey)),
buyer AS (
  SELECT CustomerKey, SalesTerritoryGroup AS Region,
         CAST(floor(date_diff('day', BirthDate, DATE '{C.AS_OF}') / 365.25) AS INTEGER) AS Age,
         CASE WHEN YearlyIncome > 60000 THEN 'High' WHEN YearlyIncome < 40000 THEN 'Low' ELSE 'Moderate' END AS IncomeGroup
  FROM dim_customer JOIN dim_geography USING (GeographyKey) JOIN dim_sales_territory USING (SalesTerritoryKey)),
modelled_product AS (
  SELECT ProductKey, EnglishProductCategoryName, coalesce(ModelName, EnglishProductName) AS Model
  FROM product_path WHERE EnglishProductCategoryName IS NOT NULL),
dm_prep AS (
  SELECT SalesOrderNumber AS OrderNumber, SalesOrderLineNumber AS LineNumber, CustomerKey, Region, Age, IncomeGroup,
         EnglishProductCategoryName, Model, CalendarYear, FiscalYear, MonthNumberOfYear AS Month,
         OrderQuantity AS Quantity, ExtendedAmount AS Amount
  FROM fact_internet_sales
  JOIN modelled_product USING (ProductKey) JOIN buyer USING (CustomerKey) JOIN order_day USING (OrderDateKey)),
labelled AS (
  SELECT {", ".join(propensity.ATTRS)}, CAST(bool_or(coalesce(EnglishProductCategoryName = {_q(C.ANCHOR_CATEGORY)}, false)) AS INTEGER)
         AS BikeBuyer
  FROM v_fact_internet_sales GROUP BY {", ".join(propensity.ATTRS)}),
raw_basket AS (
  SELECT SalesOrderNumber AS transaction_id, ProductKey AS productkey,
         coalesce(EnglishProductCategoryName, 'Not Bike') AS category FROM v_fact_reseller_sales),
line_pairs AS (
  SELECT b.productkey AS bike_key, p.productkey AS product_key, p.category AS product_category
  FROM raw_basket b JOIN raw_basket p ON b.transaction_id = p.transaction_id
  WHERE b.category = {_q(C.ANCHOR_CATEGORY)} AND p.category <> {_q(C.ANCHOR_CATEGORY)}),
pair_counts AS (SELECT bike_key, product_key, product_category, count(*) AS count
                FROM line_pairs GROUP BY ALL),
top_products AS (
  SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY bike_key, product_category ORDER BY count DESC)
                               AS INTEGER) AS rank FROM pair_counts) WHERE rank <= 3),
top_lists AS (
  SELECT bike_key,
         max(CASE WHEN pos = 1 THEN product_key END) AS Top_Product_1,
         max(CASE WHEN pos = 2 THEN product_key END) AS Top_Product_2,
         max(CASE WHEN pos = 3 THEN product_key END) AS Top_Product_3
  FROM (SELECT *, row_number() OVER (PARTITION BY bike_key ORDER BY count DESC, product_category, product_key)
                  AS pos FROM top_products) GROUP BY bike_key),
slots AS (UNPIVOT (SELECT bike_key, bike_key AS bike_name, Top_Product_1 AS upsell_1, Top_Product_2 AS upsell_2,
                          Top_Product_3 AS upsell_3 FROM top_lists)
          ON bike_name, upsell_1, upsell_2, upsell_3 INTO NAME slot VALUE ProductKey),
bike_upsells AS (
  SELECT max(EnglishProductName) FILTER (slot = 'bike_name') AS bike_name,
         max(EnglishProductName) FILTER (slot = 'upsell_1') AS upsell_1,
         max(EnglishProductName) FILTER (slot = 'upsell_2') AS upsell_2,
         max(EnglishProductName) FILTER (slot = 'upsell_3') AS upsell_3
  FROM slots LEFT JOIN dim_product USING (ProductKey) GROUP BY bike_key),
raw_scores AS (
  SELECT a.customerkey, a.spend, b.purchase_prob, c.rev, d.score
  FROM customer_spend a
  LEFT JOIN customer_purchase b ON a.customerkey = b.customerkey
  LEFT JOIN (SELECT CustomerKey AS customerkey, CAST(sum(SalesAmount) AS DOUBLE) AS rev
             FROM fact_internet_sales GROUP BY 1) c ON a.customerkey = c.customerkey
  LEFT JOIN bike_score_input d ON a.customerkey = d.customerkey),
ranks AS (
  SELECT *, CASE WHEN spend_rank <= 0.25 THEN 1 WHEN spend_rank <= 0.5 THEN 2 WHEN spend_rank <= 0.75 THEN 3
                 ELSE 4 END AS spend_quartile,
            CASE WHEN purchase_prob_rank <= 0.25 THEN 1 WHEN purchase_prob_rank <= 0.5 THEN 2
                 WHEN purchase_prob_rank <= 0.75 THEN 3 ELSE 4 END AS purchase_prob_quartile
  FROM (
    SELECT *, percent_rank() OVER (ORDER BY spend DESC NULLS LAST, rev DESC NULLS LAST) AS spend_rank,
              percent_rank() OVER (ORDER BY purchase_prob DESC NULLS LAST, rev DESC NULLS LAST)
                AS purchase_prob_rank
    FROM (
      SELECT *, CASE WHEN score = 0 THEN 0 WHEN score_rank <= 0.25 THEN 1 WHEN score_rank <= 0.5 THEN 2
                     WHEN score_rank <= 0.75 THEN 3 ELSE 4 END AS score_quartile
      FROM (SELECT * REPLACE (coalesce(score, CAST(0 AS FLOAT)) AS score),
                   percent_rank() OVER (ORDER BY coalesce(score, CAST(0 AS FLOAT)) DESC NULLS LAST,
                                        rev DESC NULLS LAST) AS score_rank
            FROM raw_scores)))),
per_customer AS (
  SELECT CustomerKey, count(DISTINCT SalesOrderNumber) AS TotalOrders, sum(OrderQuantity) AS TotalUnitsOrdered,
         avg(OrderQuantity) AS AvgUnitsOrdered, sum(SalesAmount) AS amt, count(SalesAmount) AS na,
         max(OrderDate) AS LatestOrderDate, min(OrderDate) AS EarliestOrderDate
  FROM fact_internet_sales GROUP BY 1),
avg_metrics AS (
  SELECT avg(TotalOrders) AS AvgTotalOrders, avg(TotalUnitsOrdered) AS AvgTotalUnitsOrdered,
         CAST(sum(amt) AS DOUBLE) / count(amt) AS AvgTotalSalesAmount FROM per_customer),
customer_metrics AS (
  SELECT p.CustomerKey, p.TotalOrders, CAST(p.TotalUnitsOrdered AS BIGINT) AS TotalUnitsOrdered,
         p.AvgUnitsOrdered,
         CAST(p.amt AS DOUBLE) AS TotalSalesAmount, CAST(p.amt AS DOUBLE) / p.na AS AvgSalesAmount,
         {sround('am.AvgTotalOrders', 1)} AS POP_AvgTotalOrders,
         {sround('am.AvgTotalUnitsOrdered', 1)} AS POP_AvgTotalUnitsOrdered,
         {sround('am.AvgTotalSalesAmount', 1)} AS POP_AvgTotalSalesAmount,
         p.LatestOrderDate, p.EarliestOrderDate, c.FirstName, c.LastName, c.Gender, c.HouseOwnerFlag,
         c.NumberCarsOwned, c.CommuteDistance, c.YearlyIncome
  FROM per_customer p LEFT JOIN dim_customer c ON p.CustomerKey = c.CustomerKey CROSS JOIN avg_metrics am),
customer_upsell AS (
  SELECT customerkey, list_sort(list(upsell)) AS upsell_list
  FROM (SELECT DISTINCT a.CustomerKey AS customerkey, b.upsell_1 AS upsell
        FROM v_fact_internet_sales a JOIN bike_upsells b ON a.EnglishProductName = b.bike_name)
  GROUP BY 1),
customer_details AS (
  SELECT cm.CustomerKey, cm.FirstName, cm.LastName, cm.TotalOrders, cm.TotalUnitsOrdered, cm.TotalSalesAmount,
         cm.POP_AvgTotalOrders, cm.POP_AvgTotalUnitsOrdered, cm.POP_AvgTotalSalesAmount, cm.LatestOrderDate,
         cm.EarliestOrderDate, cm.Gender, cm.HouseOwnerFlag, cm.NumberCarsOwned, cm.CommuteDistance,
         cm.YearlyIncome, cr.rev AS Lifetime_Spend, cr.spend_quartile AS future_spend_prediction_quartile,
         cr.purchase_prob_quartile AS future_purchase_prob_quartile,
         cr.score_quartile AS bike_upsell_score_quartile, cu.upsell_list
  FROM customer_metrics cm LEFT JOIN ranks cr ON cm.CustomerKey = cr.customerkey
  LEFT JOIN customer_upsell cu ON cm.CustomerKey = cu.customerkey),
span AS (SELECT ProductKey, min(OrderDate) AS first_day, (SELECT max(OrderDate) FROM fact_internet_sales) AS last_day
         FROM fact_internet_sales GROUP BY 1),
sold AS (SELECT ProductKey, OrderDate AS ds, sum(OrderQuantity) AS y FROM fact_internet_sales GROUP BY 1, 2),
grid AS (
  SELECT ProductKey, CAST(i AS BIGINT) AS t, CAST(coalesce(y, 0) AS DOUBLE) AS y
  FROM (SELECT ProductKey, first_day, unnest(range(0, date_diff('day', first_day, last_day) + 1)) AS i FROM span)
  LEFT JOIN (SELECT ProductKey, date_diff('day', first_day, ds) AS i, y FROM sold JOIN span USING (ProductKey)) USING (ProductKey, i)),
line AS (SELECT ProductKey, count(*) AS n, coalesce(regr_slope(y, t), 0) AS slope, coalesce(regr_intercept(y, t), avg(y)) AS base
         FROM grid GROUP BY 1),
weekday_effect AS (SELECT ProductKey, t % 7 AS w, avg(y - base - slope * t) AS effect FROM grid JOIN line USING (ProductKey) GROUP BY 1, 2),
forecast AS (
  SELECT ProductKey, last_day + CAST(h AS INTEGER) AS ds,
         {sbround(sround('greatest(base + slope * t + coalesce(effect, 0), 0)', 6), 0)} AS yhat
  FROM (SELECT ProductKey, last_day, base, slope, h, n - 1 + h AS t, (n - 1 + h) % 7 AS w
        FROM line JOIN span USING (ProductKey) CROSS JOIN range(1, 29) horizon(h))
  LEFT JOIN weekday_effect USING (ProductKey, w)),
weekly AS (
  SELECT ProductKey,
         sum(CASE WHEN slot = 1 THEN yhat ELSE 0.0::DOUBLE END) AS Week1Demand,
         sum(CASE WHEN slot = 2 THEN yhat ELSE 0.0::DOUBLE END) AS Week2Demand,
         sum(CASE WHEN slot = 3 THEN yhat ELSE 0.0::DOUBLE END) AS Week3Demand,
         sum(CASE WHEN slot = 4 THEN yhat ELSE 0.0::DOUBLE END) AS Week4Demand
  FROM (SELECT ProductKey, yhat,
               CAST(date_diff('day', min(CAST(date_trunc('week', ds) AS DATE)) OVER (PARTITION BY ProductKey),
                              CAST(date_trunc('week', ds) AS DATE)) / 7 + 1 AS INTEGER) AS slot
        FROM forecast)
  WHERE slot <= 4 GROUP BY 1),
stock_position AS (
  SELECT ProductKey, arg_max(UnitsBalance, DateKey) AS UnitsBalance, arg_max(LeadTimeWeeks, DateKey) AS LeadTimeWeeks
  FROM fact_product_inventory GROUP BY 1),
demand AS (
  SELECT a.ProductKey, a.UnitsBalance, a.LeadTimeWeeks, b.Week1Demand, b.Week2Demand, b.Week3Demand,
         b.Week4Demand, b.Week1Demand + b.Week2Demand + b.Week3Demand + b.Week4Demand AS TotalForecastedDemand
  FROM stock_position a JOIN weekly b ON a.ProductKey = b.ProductKey),
demand_rank AS (
  SELECT *, row_number() OVER (ORDER BY TotalForecastedDemand DESC, ProductKey) AS Rank,
         count(*) OVER () AS TotalCount FROM demand),
margin AS (
  SELECT ProductKey, {sround('CAST(sum(Profit) AS DOUBLE) / nullif(CAST(sum(SalesAmount) AS DOUBLE), 0)', 2)}
         AS Margin_Pct FROM fact_internet_sales GROUP BY ALL),
reorder AS (
  SELECT * EXCLUDE (Rank, TotalCount),
         greatest(0.0::DOUBLE, CASE WHEN Rank > 0.2 * TotalCount THEN TotalForecastedDemand + 1 - UnitsBalance
                                    ELSE CAST(ceil(1.15::DOUBLE * TotalForecastedDemand) - UnitsBalance AS DOUBLE) END) AS OrderQuantity
  FROM demand_rank),
inventory_status AS (
  SELECT *, CAST(UnitsBalance > 0 AS INTEGER) AS HasStock, CAST(OrderQuantity > 0 AS INTEGER) AS NeedsOrder,
         if(UnitsBalance > 0, 0, LeadTimeWeeks) AS WeeksUntilStockAvailable
  FROM reorder LEFT JOIN margin USING (ProductKey)),
describable AS (
  SELECT a.*, b.EnglishProductSubcategoryName, c.ProductCategoryKey, c.EnglishProductCategoryName
  FROM dim_product a LEFT JOIN dim_product_subcategory b ON a.ProductSubcategoryKey = b.ProductSubcategoryKey
  LEFT JOIN dim_product_category c ON c.ProductCategoryKey = b.ProductCategoryKey
  WHERE c.EnglishProductCategoryName = {_q(C.ANCHOR_CATEGORY)} AND a.EnglishDescription IS NOT NULL),
emb AS (SELECT vec_id, embedding, label FROM embeddings),
qvec AS (SELECT embedding AS q FROM emb WHERE vec_id = {C.QUERY_VEC_ID} LIMIT 1),
hits AS (
  SELECT vec_id AS productkey, round(score, 6) AS score FROM (
    SELECT e.vec_id,
           list_sum(list_transform(list_zip(e.embedding, qv.q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))
           / nullif(sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
                    * sqrt(list_sum(list_transform(qv.q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0) AS score
    FROM emb e CROSS JOIN qvec qv)
  ORDER BY score DESC NULLS LAST, vec_id LIMIT {C.SEARCH_K}),
returns AS (SELECT l_orderkey AS OrderNumber, l_linenumber AS LineNumber FROM lineitem WHERE l_returnflag = 'R'),
email_rows AS (
  SELECT DISTINCT CustomerKey, EmailAddress, FirstName, LastName, SalesOrderNumber, SalesOrderLineNumber,
         EnglishProductName, OrderQuantity, UnitPrice
  FROM v_fact_internet_sales v
  WHERE EXISTS (SELECT 1 FROM returns r WHERE r.OrderNumber = v.SalesOrderNumber
                                          AND r.LineNumber = v.SalesOrderLineNumber)),
email_json AS (
  SELECT CustomerKey, SalesOrderNumber, SalesOrderLineNumber,
         '{{' || concat_ws(',',
            '"EmailAddress":' || to_json(EmailAddress), '"FirstName":' || to_json(FirstName),
            '"LastName":' || to_json(LastName), '"SalesOrderNumber":' || CAST(SalesOrderNumber AS VARCHAR),
            '"SalesOrderLineNumber":' || CAST(SalesOrderLineNumber AS VARCHAR),
            '"EnglishProductName":' || to_json(EnglishProductName),
            '"OrderQuantity":' || CAST(OrderQuantity AS VARCHAR), '"UnitPrice":' || CAST(UnitPrice AS VARCHAR),
            '"Offer":"30% off 1 Item"', '"CouponCode":"Qx2V3mW8FjCt"', '"SalesRepName":"Adam"',
            '"CompanyName":"Adventure Works"') || '}}' AS json_string
  FROM email_rows)
"""


def _with(body: str) -> str:
    return "WITH " + BINDING.strip() + "\n" + body


_STOP = ", ".join(_q(w) for w in sorted(set(STOP_WORDS)))


def _keywords_sql(src: str, id_col: str, text_col: str, k: int) -> str:
    return f"""
, toks AS (
  SELECT id, term FROM (
    SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}]+')) AS term FROM {src})
  WHERE length(term) >= 3 AND term NOT IN ({_STOP})),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
dfc AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
nd AS (SELECT count(*) AS N FROM {src}),
scored AS (SELECT tf.id, tf.term, tf.tf * ln(CAST(nd.N + 1 AS DOUBLE) / CAST(dfc.df + 1 AS DOUBLE)) AS score
           FROM tf JOIN dfc ON tf.term = dfc.term CROSS JOIN nd),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS r FROM scored)
         WHERE r <= {k}),
kw AS (SELECT id, string_agg(term, ', ' ORDER BY r) AS refined_description FROM topk GROUP BY 1)
"""


def _num(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


RECAP_JSON = """'{' || concat_ws(',',
   '"CustomerKey":' || CAST(CustomerKey AS VARCHAR), '"FirstName":' || to_json(FirstName),
   '"LastName":' || to_json(LastName), '"TotalOrders":' || CAST(TotalOrders AS VARCHAR),
   '"TotalUnitsOrdered":' || CAST(TotalUnitsOrdered AS VARCHAR),
   '"TotalSalesAmount":' || CAST(TotalSalesAmount AS VARCHAR),
   '"POP_AvgTotalOrders":' || CAST(POP_AvgTotalOrders AS VARCHAR),
   '"POP_AvgTotalUnitsOrdered":' || CAST(POP_AvgTotalUnitsOrdered AS VARCHAR),
   '"POP_AvgTotalSalesAmount":' || CAST(POP_AvgTotalSalesAmount AS VARCHAR),
   '"LatestOrderDate":' || to_json(LatestOrderDate), '"EarliestOrderDate":' || to_json(EarliestOrderDate),
   '"Gender":' || to_json(Gender), '"HouseOwnerFlag":' || to_json(HouseOwnerFlag),
   '"NumberCarsOwned":' || CAST(NumberCarsOwned AS VARCHAR), '"CommuteDistance":' || to_json(CommuteDistance),
   '"YearlyIncome":' || CAST(YearlyIncome AS VARCHAR), '"Lifetime_Spend":' || CAST(Lifetime_Spend AS VARCHAR),
   '"future_spend_prediction_quartile":' || CAST(future_spend_prediction_quartile AS VARCHAR),
   '"future_purchase_prob_quartile":' || CAST(future_purchase_prob_quartile AS VARCHAR),
   '"bike_upsell_score_quartile":' || CAST(bike_upsell_score_quartile AS VARCHAR),
   '"upsell_list":' || to_json(upsell_list)) || '}'"""

# each view: the fact with its dimensions, joined on the key they share
STAR_SIMPLE = {
    "star_call_center": "SELECT * FROM fact_call_center LEFT JOIN dim_date USING (DateKey)",
    "star_currency_rate": "SELECT * FROM fact_currency_rate LEFT JOIN dim_date USING (DateKey) LEFT JOIN dim_currency USING (CurrencyKey)",
    "star_finance": """SELECT * FROM fact_finance LEFT JOIN dim_date USING (DateKey) LEFT JOIN dim_organization USING (OrganizationKey)
                       LEFT JOIN dim_account USING (AccountKey) LEFT JOIN dim_department_group USING (DepartmentGroupKey)""",
    "star_sales_quota": """SELECT * FROM fact_sales_quota LEFT JOIN dim_employee USING (EmployeeKey)
                           LEFT JOIN (SELECT * EXCLUDE (CalendarYear, CalendarQuarter) FROM dim_date) USING (DateKey)""",
    "star_survey": "SELECT * FROM fact_survey_response LEFT JOIN dim_date USING (DateKey) LEFT JOIN dim_customer USING (CustomerKey)",
    "star_sales_reason": """SELECT * FROM fact_internet_sales_reason LEFT JOIN dim_sales_reason USING (SalesReasonKey)
                            LEFT JOIN fact_internet_sales USING (SalesOrderNumber, SalesOrderLineNumber)
                            LEFT JOIN order_day USING (OrderDateKey)""",
    "sales_reason_colocated": """SELECT * FROM fact_internet_sales_reason LEFT JOIN dim_sales_reason USING (SalesReasonKey)
                            LEFT JOIN fact_internet_sales USING (SalesOrderNumber, SalesOrderLineNumber)
                            LEFT JOIN order_day USING (OrderDateKey)""",
    "star_internet_sales": "SELECT * FROM v_fact_internet_sales",
    "star_reseller_sales": "SELECT * FROM v_fact_reseller_sales",
}

def _seasonal_sql() -> str:
    """Observed sums of units times each basis function; at the least squares the fitted ones are the same."""
    bends = [f"greatest(d - first_day - (last_day - first_day) * {k} // 5, 0)" for k in range(1, 5)]
    weekdays = [f"CAST(d % 7 = {k} AS INTEGER)" for k in range(1, 7)]
    waves = [f"{f}(d * (2 * pi() * {m} / 365.25))" for f in ("sin", "cos") for m in range(1, 4)]
    sums = ", ".join(f"sum(CAST(q AS DOUBLE) * ({f}))" for f in ("1", "d - first_day", *bends, *weekdays, *waves))
    return f"""
        SELECT ProductKey, CAST(feature AS INTEGER) AS feature, {sround('sums[feature + 1]', 3)} + 0.0::DOUBLE AS observed,
               {sround('sums[feature + 1]', 3)} + 0.0::DOUBLE AS fitted
        FROM (SELECT ProductKey, [{sums}] AS sums
              FROM (SELECT ProductKey, OrderQuantity AS q, date_diff('day', DATE '1970-01-01', OrderDate) AS d,
                           date_diff('day', DATE '1970-01-01', (SELECT min(OrderDate) FROM fact_internet_sales)) AS first_day,
                           date_diff('day', DATE '1970-01-01', (SELECT max(OrderDate) FROM fact_internet_sales)) AS last_day
                    FROM fact_internet_sales)
              GROUP BY 1) CROSS JOIN (SELECT unnest(range(18)) AS feature)"""


def _equations_sql() -> str:
    """Per feature of the propensity model its sum over the buyers; codes by frequency, ties alphabetically, missing values last."""
    codes = "".join(f"""
        , code_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c} IS NULL, count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS DOUBLE) AS code FROM labelled GROUP BY 1)"""
                    for c in CATEGORICAL)
    sums = "".join(f"""
        UNION ALL SELECT '{c}', round(sum(CAST({c} AS DOUBLE)) FILTER (BikeBuyer = 1), 3), true FROM aged""" for c in NUMERIC)
    sums += "".join(f"""
        UNION ALL SELECT '{c}_code', round(sum(code) FILTER (BikeBuyer = 1), 3), true FROM labelled JOIN code_{c} ON {c} IS NOT DISTINCT FROM v""" for c in CATEGORICAL)
    return f"""{codes}
        , aged AS (SELECT *, date_diff('day', BirthDate, DATE '{C.AS_OF}') / 365 AS Age FROM labelled)
        SELECT 'intercept' AS feature, round(sum(CAST(BikeBuyer AS DOUBLE)), 3) AS observed, true AS solved FROM labelled{sums}"""


BODIES = {
    **STAR_SIMPLE,
    "customer_metrics": "SELECT * FROM customer_metrics",
    "population_averages": "SELECT * FROM avg_metrics",
    "stock_position": "SELECT * FROM stock_position",
    "dm_prep": "SELECT * FROM dm_prep",
    "dm_null_violations": "SELECT * FROM dm_prep WHERE Model IS NULL OR Region IS NULL",
    "assoc_line_items": f"SELECT OrderNumber, LineNumber, Model FROM dm_prep WHERE FiscalYear = '{C.FISCAL_YEAR}'",
    "assoc_orders": f"""SELECT DISTINCT OrderNumber, CustomerKey, Region, IncomeGroup FROM dm_prep
                        WHERE FiscalYear = '{C.FISCAL_YEAR}'""",
    "target_mail": f"""SELECT {", ".join(mining.TARGET_MAIL_ATTRIBUTES)}, Region, Age, CAST(bought AS INTEGER) AS BikeBuyer
                       FROM (SELECT CustomerKey, Region, Age,
                                    bool_or(EnglishProductCategoryName = {_q(C.ANCHOR_CATEGORY)}) AS bought
                             FROM dm_prep GROUP BY ALL) JOIN dim_customer USING (CustomerKey)""",
    "time_series": """SELECT code || ' ' || Region AS ModelRegion, CalendarYear * 100 + Month AS TimeIndex,
                             sum(Quantity) AS Quantity, sum(Amount) AS Amount, CalendarYear, Month,
                             make_date(CalendarYear, Month, 25) AS ReportingDate
                      FROM dm_prep
                      JOIN (VALUES ('ECONOMY', 'SARD'), ('LARGE', 'LRGE'), ('MEDIUM', 'MIUM'), ('PROMO', 'POMO'),
                                   ('SMALL', 'MIUM'), ('STANDARD', 'SARD')) codes(Model, code) USING (Model)
                      GROUP BY ALL""",
    "category_diversity": """SELECT cats, count(1) AS count FROM (
                               SELECT count(DISTINCT category) AS cats, transaction_id FROM raw_basket
                               GROUP BY transaction_id) GROUP BY cats""",
    "anchor_basket_lines": f"""SELECT * FROM raw_basket WHERE transaction_id IN (
                                 SELECT transaction_id FROM raw_basket WHERE category = {_q(C.ANCHOR_CATEGORY)})""",
    "pair_counts": "SELECT * FROM pair_counts",
    "top_products": "SELECT * FROM top_products",
    "top_lists": "SELECT * FROM top_lists",
    "upsell_table": "SELECT * FROM bike_upsells",
    "buyers": "SELECT * EXCLUDE (BikeBuyer) FROM labelled WHERE BikeBuyer = 1",
    "non_buyers": "SELECT * EXCLUDE (BikeBuyer) FROM labelled WHERE BikeBuyer = 0",
    "propensity_facts": """SELECT count(*) FILTER (BikeBuyer = 0) AS scored, count(*) FILTER (BikeBuyer = 0) AS customers,
                                  sum(CustomerKey) FILTER (BikeBuyer = 0) AS key_sum,
                                  count(*) FILTER (BikeBuyer = 0) AS in_range, sum(BikeBuyer) AS buyers, true AS calibrated
                           FROM labelled""",
    "model_chain": "SELECT CustomerKey AS customerkey, BikeBuyer = 0 AS scored FROM labelled",
    "customer_revenue": """SELECT CustomerKey AS customerkey, CAST(sum(SalesAmount) AS DOUBLE) AS rev
                           FROM fact_internet_sales GROUP BY 1""",
    "model_scores": "SELECT * FROM raw_scores",
    "quartiles": "SELECT * FROM ranks",
    "customer_upsells": "SELECT customerkey, array_to_string(upsell_list, '|') AS upsell_list FROM customer_upsell",
    "customer_360": "SELECT * REPLACE (array_to_string(upsell_list, '|') AS upsell_list) FROM customer_details",
    "badges": """SELECT DISTINCT CustomerKey, future_spend_prediction_quartile, future_purchase_prob_quartile,
                        CASE WHEN future_spend_prediction_quartile IN (1, 2) AND future_purchase_prob_quartile IN (1, 2)
                             THEN 'Gold'
                             WHEN future_spend_prediction_quartile IN (3, 4) AND future_purchase_prob_quartile IN (3, 4)
                             THEN 'Bronze' ELSE 'Silver' END AS badge
                 FROM customer_details""",
    "first_sale": "SELECT ProductKey, min(OrderDate) AS FirstSaleDate FROM fact_internet_sales GROUP BY 1",
    "demand_grid_stats": """
        SELECT ds.ProductKey, min(ds.ds) AS first_ds, count(*) AS days,
               count_if(coalesce(v.y, 0) = 0) AS zero_days, CAST(sum(coalesce(v.y, 0)) AS BIGINT) AS total
        FROM (SELECT f.ProductKey, d.FullDateAlternateKey AS ds
              FROM (SELECT ProductKey, min(OrderDate) AS first FROM fact_internet_sales GROUP BY 1) f
              JOIN dim_date d ON d.FullDateAlternateKey >= f.first
                             AND d.FullDateAlternateKey <= (SELECT max(OrderDate) FROM fact_internet_sales)) ds
        LEFT JOIN (SELECT ProductKey, OrderDate, sum(OrderQuantity) AS y FROM fact_internet_sales GROUP BY 1, 2) v
          ON ds.ProductKey = v.ProductKey AND ds.ds = v.OrderDate
        GROUP BY 1""",
    "demand_forecast": "SELECT ProductKey, ds, yhat FROM forecast",
    "seasonal_equations": _seasonal_sql(),
    "weekly_demand": "SELECT * FROM weekly",
    "margin": "SELECT * FROM margin",
    "demand_rank": "SELECT * FROM demand_rank",
    "inventory_status": "SELECT * FROM inventory_status",
    "distinct_descriptions": "SELECT DISTINCT EnglishDescription FROM dim_product",
    "describable_products": "SELECT * FROM describable",
    "prompts": f"""SELECT ProductKey AS productkey, EnglishDescription AS description, Size AS size,
                          Weight AS weight,
                          {_q(KEYWORD_INSTRUCTION)} || EnglishDescription || ', Size: ' || Size || ', Weight: '
                            || CAST(Weight AS VARCHAR) || '"' AS prompt
                   FROM describable""",
    "cosine_topk": "SELECT productkey AS vec_id, score FROM hits",
    "cosine_topk_many": """
        SELECT label, vec_id, round(score, 6) AS score, rank FROM (
          SELECT q.label, e.vec_id, s.score,
                 CAST(row_number() OVER (PARTITION BY q.label ORDER BY s.score DESC NULLS LAST, e.vec_id) AS INTEGER)
                   AS rank
          FROM (SELECT label, arg_min(embedding, vec_id) AS q FROM emb GROUP BY 1) q CROSS JOIN emb e
          CROSS JOIN LATERAL (SELECT
            list_sum(list_transform(list_zip(e.embedding, q.q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))
            / nullif(sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
                     * sqrt(list_sum(list_transform(q.q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0) AS score) s)
        WHERE rank <= 3""",
    "search_enriched": """SELECT p.EnglishProductName AS "Bike Name", p.Weight, p.Size, i.HasStock AS "Has Stock",
                                 i.Margin_Pct AS Margin, js.score AS Similarity
                          FROM hits js LEFT JOIN dim_product p ON js.productkey = p.ProductKey
                          LEFT JOIN inventory_status i ON js.productkey = i.ProductKey
                          ORDER BY js.score DESC""",
    "search_described": """SELECT js.productkey, p.EnglishProductName, p.EnglishDescription, i.HasStock,
                                  i.WeeksUntilStockAvailable, i.Margin_Pct
                           FROM hits js LEFT JOIN dim_product p ON js.productkey = p.ProductKey
                           LEFT JOIN inventory_status i ON js.productkey = i.ProductKey""",
    "recap_json": f"""SELECT CustomerKey, {RECAP_JSON} AS json_string,
                             {_q(RECAP_INSTRUCTION)} || {RECAP_JSON} AS prompt
                      FROM customer_details""",
    "return_email_json": "SELECT * FROM email_json",
    "order_json": """SELECT CustomerKey, SalesOrderNumber,
                            string_agg(json_string, ' ' ORDER BY SalesOrderLineNumber, json_string) AS order_json
                     FROM email_json GROUP BY 1, 2""",
    "customers": """SELECT DISTINCT CustomerKey, FirstName, LastName, EmailAddress, AddressLine1
                    FROM v_fact_internet_sales""",
    "order_history": """SELECT DISTINCT '"' || CAST(CustomerKey AS VARCHAR) || '"' AS "Customer Key",
                               b.FullDateAlternateKey AS "Date", SalesOrderNumber AS "Order Number"
                        FROM v_fact_internet_sales a LEFT JOIN dim_date b ON a.OrderDateKey = b.DateKey""",
    "order_lines": """SELECT DISTINCT CustomerKey, SalesOrderNumber, SalesOrderLineNumber AS "Line Number",
                             b.FullDateAlternateKey AS "Date", EnglishProductName AS "Name",
                             OrderQuantity AS "Quantity", UnitPrice AS "Unit Price"
                      FROM v_fact_internet_sales a LEFT JOIN dim_date b ON a.OrderDateKey = b.DateKey""",
    "stocked_products": """SELECT DISTINCT a.ProductKey, EnglishProductName FROM dim_product a
                           JOIN inventory_status b ON a.ProductKey = b.ProductKey""",
    "inventory_lookup": """SELECT ProductKey, UnitsBalance, LeadTimeWeeks, TotalForecastedDemand, OrderQuantity,
                                  HasStock, NeedsOrder, WeeksUntilStockAvailable, Margin_Pct FROM inventory_status""",
    "picker_labels": """SELECT CustomerKey, FirstName || ' ' || LastName || ' - ' || EmailAddress AS label
                        FROM (SELECT DISTINCT CustomerKey, FirstName, LastName, EmailAddress, AddressLine1
                              FROM v_fact_internet_sales)""",
    "freshness": """
        SELECT 'DimCustomer' AS "table", 'DateFirstPurchase' AS "column", CAST(max(DateFirstPurchase) AS VARCHAR)
               AS max_value FROM dim_customer
        UNION ALL SELECT 'DimDate', 'FiscalYear', CAST(max(FiscalYear) AS VARCHAR) FROM dim_date
        UNION ALL SELECT 'DimPromotion', 'EndDate', CAST(max(EndDate) AS VARCHAR) FROM dim_promotion
        UNION ALL SELECT 'DimEmployee', 'StartDate', CAST(max(StartDate) AS VARCHAR) FROM dim_employee
        UNION ALL SELECT 'DimProduct', 'EndDate', CAST(max(EndDate) AS VARCHAR) FROM dim_product
        UNION ALL SELECT 'FactCallCenter', 'Date', CAST(max(Date) AS VARCHAR) FROM fact_call_center
        UNION ALL SELECT 'FactFinance', 'Date', CAST(max(Date) AS VARCHAR) FROM fact_finance
        UNION ALL SELECT 'FactInternetSales', 'ShipDate', CAST(max(ShipDate) AS VARCHAR) FROM fact_internet_sales
        UNION ALL SELECT 'FactResellerSales', 'OrderDate', CAST(max(OrderDate) AS VARCHAR) FROM fact_reseller_sales
        UNION ALL SELECT 'FactSurveyResponse', 'Date', CAST(max(Date) AS VARCHAR) FROM fact_survey_response""",
    "freshness_footers": """
        SELECT 'lineitem' AS "table", 'l_orderkey' AS "column", CAST(max(l_orderkey) AS VARCHAR) AS max_value,
               count(*) AS row_count FROM lineitem
        UNION ALL SELECT 'lineitem', 'l_partkey', CAST(max(l_partkey) AS VARCHAR), count(*) FROM lineitem
        UNION ALL SELECT 'lineitem', 'l_linenumber', CAST(max(l_linenumber) AS VARCHAR), count(*) FROM lineitem
        UNION ALL SELECT 'lineitem', 'l_shipdate', CAST(max(l_shipdate) AS VARCHAR), count(*) FROM lineitem
        UNION ALL SELECT 'orders', 'o_orderkey', CAST(max(o_orderkey) AS VARCHAR), count(*) FROM orders
        UNION ALL SELECT 'orders', 'o_custkey', CAST(max(o_custkey) AS VARCHAR), count(*) FROM orders
        UNION ALL SELECT 'customer', 'c_custkey', CAST(max(c_custkey) AS VARCHAR), count(*) FROM customer
        UNION ALL SELECT 'part', 'p_partkey', CAST(max(p_partkey) AS VARCHAR), count(*) FROM part
        UNION ALL SELECT 'supplier', 's_suppkey', CAST(max(s_suppkey) AS VARCHAR), count(*) FROM supplier
        UNION ALL SELECT 'events', 'event_id', CAST(max(event_id) AS VARCHAR), count(*) FROM events
        UNION ALL SELECT 'events', 'user_id', CAST(max(user_id) AS VARCHAR), count(*) FROM events""",
    "reconcile": """SELECT 'lineitem' AS "table", count(*) AS pre_count,
                           count_if(coalesce(l_shipdate < TIMESTAMP '2001-01-01', false)) AS post_count
                    FROM lineitem""",
    "profit": """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS ExtendedAmount,
                        CAST(l_extendedprice * (1.0::DOUBLE - l_discount) AS DECIMAL(18,4)) AS SalesAmount,
                        CAST(CAST(l_extendedprice * (1.0::DOUBLE - l_discount) AS DECIMAL(18,4))
                             - CAST(l_extendedprice * 0.6::DOUBLE AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS Profit,
                        CAST(l_extendedprice * 0.6::DOUBLE AS DECIMAL(18,4)) AS TotalProductCost
                 FROM lineitem""",
    "ingest_roundtrip": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS source_rows, count(*) AS written_rows, true AS same_content FROM {t}"
        for t in C.DRIVER_CATALOG),
    "replace_append_table": "SELECT o_orderkey, o_orderstatus FROM orders",
    "shift_employees": """SELECT * REPLACE (CAST(StartDate + INTERVAL 11 YEAR AS DATE) AS StartDate,
                                            CAST(EndDate + INTERVAL 11 YEAR AS DATE) AS EndDate)
                          FROM dim_employee WHERE StartDate + INTERVAL 11 YEAR < DATE '2007-06-01'
                                              AND coalesce(EndDate + INTERVAL 11 YEAR < DATE '2007-06-01', true)""",
    "shift_calendar": """SELECT * REPLACE (CAST(FullDateAlternateKey + INTERVAL 132 MONTH AS DATE) AS FullDateAlternateKey,
                                           CAST(CalendarYear + 11 AS INTEGER) AS CalendarYear,
                                           CAST(FiscalYear + 11 AS INTEGER) AS FiscalYear) FROM dim_date""",
    "propensity_equations": _equations_sql(),
    "clustered_write": "SELECT * FROM fact_internet_sales",
    "interleaved_write": f"""SELECT * FROM fact_internet_sales
                             WHERE OrderDate BETWEEN DATE '{C.LAYOUT_DATES[0]}' AND DATE '{C.LAYOUT_DATES[1]}'""",
    "append_returns": """SELECT OrderNumber, LineNumber FROM returns r WHERE EXISTS (
                           SELECT 1 FROM fact_internet_sales s WHERE s.SalesOrderNumber = r.OrderNumber
                                                                AND s.SalesOrderLineNumber = r.LineNumber)""",
    "json_export": "SELECT * FROM customer_metrics",
    "returns_stream": "SELECT * FROM email_json",
    "training_set": f"SELECT *, date_diff('day', BirthDate, DATE '{C.AS_OF}') / 365 AS Age FROM labelled",
    "top_products_by_name": f"""
        , lines AS (
          SELECT f.SalesOrderNumber AS transaction_id, p.EnglishProductName AS productkey,
                 coalesce(CASE WHEN s.p_brand = {_q(C.ANCHOR_CATEGORY)} THEN 'Anchor' ELSE p.ModelName END,
                          'Other') AS category
          FROM fact_reseller_sales f LEFT JOIN dim_product p ON f.ProductKey = p.ProductKey
          LEFT JOIN dim_product_subcategory s ON p.ProductSubcategoryKey = s.ProductSubcategoryKey),
        cnt AS (
          SELECT b.productkey AS bike_key, o.productkey AS product_key, o.category AS product_category,
                 count(*) AS count
          FROM lines b JOIN lines o ON b.transaction_id = o.transaction_id
          WHERE b.category = 'Anchor' AND o.category <> 'Anchor' GROUP BY ALL)
        SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY bike_key, product_category ORDER BY count DESC)
                                      AS INTEGER) AS rank FROM cnt) WHERE rank <= 3""",
    "shift_dates": """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 132 MONTH AS DATE) AS o_orderdate
                      FROM orders
                      WHERE CAST(CAST(o_orderdate AS DATE) + INTERVAL 132 MONTH AS DATE) < DATE '2010-04-30'
                         OR o_orderdate IS NULL""",
}

KEYWORD_BODIES = {
    "keywords": ("documents", "doc_id", "text",
                 "SELECT d.doc_id, coalesce(kw.refined_description, '') AS refined_description FROM documents d LEFT JOIN kw ON d.doc_id = kw.id"),
    "product_keywords": ("describable", "ProductKey", "EnglishDescription",
                         """SELECT d.ProductKey AS productkey, d.EnglishDescription AS description,
                                   coalesce(kw.refined_description, '') AS refined_description
                            FROM describable d LEFT JOIN kw ON d.ProductKey = kw.id"""),
    "similarity_search": ("describable", "ProductKey", "EnglishDescription",
                          """SELECT h.productkey, CASE WHEN d.ProductKey IS NOT NULL THEN coalesce(kw.refined_description, '') END AS refined_description, h.score
                             FROM hits h LEFT JOIN describable d ON h.productkey = d.ProductKey LEFT JOIN kw ON d.ProductKey = kw.id"""),
}


def _build() -> dict[str, str]:
    out = {k: _with(v) for k, v in BODIES.items()}
    for name, (src, idc, txt, body) in KEYWORD_BODIES.items():
        out[name] = _with(_keywords_sql(src, idc, txt, C.KEYWORDS_K).rstrip() + "\n" + body)
    return out


ORACLE_SQL: dict[str, str] = _build()
