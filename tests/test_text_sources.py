import datetime as dt
import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMOKE, rows
from shelfwise.operators import text
from shelfwise.sources import ingest


def test_cosine_topk_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [1.0, 1.0])],
                                   "id long, v array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    got = rows(text.cosine_topk(corpus, "id", "v", q, k=10))  # k larger than the corpus
    assert [r["id"] for r in got] == [1, 4, 5, 2, 3]           # duplicate score 1.0 ordered by id
    assert got[0]["score"] == pytest.approx(1.0) and got[2]["score"] == pytest.approx(1 / math.sqrt(2))
    assert got[3]["score"] is None and got[4]["score"] is None  # zero and NULL vectors


def test_cosine_topk_many_null_and_text_ids(spark):
    corpus = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "id int, v array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 1.0]), ("c", [0.0, 0.0, 0.0])], "qid string, qv array<double>")
    got = rows(text.cosine_topk_many(corpus, "id", "v", queries, "qid", "qv", k=3))
    assert len(got) == 9 and {r["query_id"] for r in got} == {"a", None, "c"}
    vectors = {i: (float(i % 5), float(i % 3), 1.0) for i in range(30)}
    for q, x in (("a", (1.0, 0.0, 0.0)), (None, (0.0, 1.0, 1.0))):
        cos = {i: sum(p * r for p, r in zip(v, x)) / math.sqrt(sum(p * p for p in v) * sum(p * p for p in x)) for i, v in vectors.items()}
        best = sorted(cos.values(), reverse=True)[:3]
        mine = sorted((r["score"] for r in got if r["query_id"] == q), reverse=True)
        assert all(abs(m - e) < 1e-9 for m, e in zip(mine, best))


def test_search_wants_exactly_one_query(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [3.0])], "id int, v array<double>")
    for frame in (lambda: text.query_vector(corpus, "id", "v", 1), lambda: text.query_vector(corpus, "id", "v", 9),
                  lambda: text.cosine_topk(corpus, "id", "v", corpus.select("v"))):
        with pytest.raises(ValueError):
            frame()
    assert text.cosine_topk(corpus, "id", "v", text.query_vector(corpus, "id", "v", 2)).count() == 3


def test_jdbc_options_split_each_table_by_itself():
    split = ingest.Split("OrderKey", 1, 1000, 8)
    assert ingest.jdbc_options("jdbc:x", "T", {"user": "u"}) == {"url": "jdbc:x", "dbtable": "T", "user": "u"}
    got = ingest.jdbc_options("jdbc:x", "T", {}, split)
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("OrderKey", "1", "1000", "8")


def test_shift_table_cutoffs_years_and_nulls(spark):
    d = dt.date
    people = spark.createDataFrame([(1, d(2010, 1, 1), None), (2, d(2010, 1, 1), d(2012, 1, 1)), (3, d(2010, 1, 1), d(2014, 1, 1)), (4, d(2014, 1, 1), None)],
                                   "k int, StartDate date, EndDate date")
    got = rows(ingest.shift_table(people, "DimEmployee"), "k")
    assert [(r["k"], r["StartDate"], r["EndDate"]) for r in got] == [(1, d(2021, 1, 1), None), (2, d(2021, 1, 1), d(2023, 1, 1))]
    years = spark.createDataFrame([(2000, 1999)], "YearOpened int, LastOrderYear int")
    assert rows(ingest.shift_table(years, "DimReseller")) == [{"YearOpened": 2011, "LastOrderYear": 2010}]
    assert rows(ingest.shift_table(years, "Unlisted")) == rows(years)


def test_session_settings_leave_the_cluster_alone():
    from shelfwise.session import is_local, session_settings
    assert not {"spark.master", "spark.sql.shuffle.partitions", "spark.driver.memory"} & set(session_settings())
    assert session_settings("yarn", 400)["spark.sql.shuffle.partitions"] == "400"
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")


def test_keywords_tfidf(spark):
    docs = spark.createDataFrame([(1, "Light light frame, the frame!"), (2, "Heavy frame"), (3, "")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["refined_description"] for r in rows(text.keywords(docs, "doc_id", "text", k=2))}
    # idf(light) = ln(4/2), idf(frame) = ln(4/3): light (tf 2) first; 'the' is a stop word
    assert got == {1: "light, frame", 2: "heavy, frame", 3: ""}


def test_prompts_null_semantics(spark):
    d = spark.createDataFrame([(1, "Fast bike", "52", 8.5), (2, "No weight", "48", None)],
                              "ProductKey long, EnglishDescription string, Size string, Weight double")
    got = {r["productkey"]: r["prompt"] for r in rows(text.prompts(d))}
    assert got[1].endswith('"Fast bike, Size: 52, Weight: 8.5"') and got[2] is None
    safe = {r["productkey"]: r["prompt"] for r in rows(text.prompts(d, null_safe=True))}
    assert safe[2].endswith('"No weight, Size: 48, Weight: "')


def test_json_payloads_drop_nulls_and_keep_line_order(spark):
    lines = spark.createDataFrame(
        [(1, 7, 2, '{"b":2}'), (1, 7, 1, '{"a":"é \\"q\\""}')],
        "CustomerKey long, SalesOrderNumber long, SalesOrderLineNumber int, json_string string")
    got = rows(text.order_json(lines))
    assert got[0]["order_json"] == '{"a":"é \\"q\\""} {"b":2}'
    df = spark.createDataFrame([(1, None, "x")], "a long, b string, c string")
    assert json.loads(rows(ingest.json_export(df))[0]["json"]) == {"a": 1, "c": "x"}


def test_snake_names():
    assert ingest.snake_name("FactInternetSales") == "fact_internet_sales"
    assert ingest.snake_name("NewFactCurrencyRate") == "new_fact_currency_rate"
    assert ingest.snake_name("sysdiagrams") == "sysdiagrams"
    assert len(ingest.SOURCE_CATALOG) == 29


def test_reconcile_profit_shift(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, v int")
    r = rows(ingest.reconcile([("t", df, F.col("v") < 10)]))
    assert r == [{"table": "t", "pre_count": 3, "post_count": 1}]
    f = spark.createDataFrame([(1, 10.0, 4.0, 7)], "id int, SalesAmount double, TotalProductCost double, x int")
    p = ingest.add_profit(f)
    assert p.columns == ["id", "SalesAmount", "Profit", "TotalProductCost", "x"] and rows(p)[0]["Profit"] == 6.0
    d = spark.createDataFrame([(1, "2012-01-31"), (2, "2014-01-01"), (3, None)], "id int, d string") \
             .withColumn("d", F.to_date("d"))
    s = rows(ingest.shift_dates(d, ["d"], 132, cutoff="2024-04-30", cutoff_col="d"), "id")
    assert [r["id"] for r in s] == [1, 3] and str(s[0]["d"]) == "2023-01-31"


def test_ingest_clustered_roundtrip_and_append(spark):
    root = tempfile.mkdtemp(prefix="shelfwise-test-", dir="/tmp")
    src = {"FactThing": spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "ThingKey int, v string"),
           "DimOther": spark.createDataFrame([(1,)], "OtherKey int")}
    recon = ingest.ingest(spark, lambda t: src[t], root, catalog={"FactThing": "ThingKey", "DimOther": "OtherKey"})
    assert {r["table"]: r["pre_count"] for r in rows(recon)} == {"fact_thing": 3, "dim_other": 1}
    back = spark.read.parquet(os.path.join(root, "fact_thing"))
    assert sorted(r["ThingKey"] for r in rows(back)) == [1, 2, 3]
    sales = spark.createDataFrame([(10, 1), (10, 2)], "SalesOrderNumber long, SalesOrderLineNumber int")
    ret = spark.createDataFrame([(10, 2), (11, 1)], "OrderNumber long, LineNumber int")
    path = os.path.join(root, "fact_returns")
    ingest.append_returns(ret, sales, path)
    ingest.append_returns(ret, sales, path)
    assert rows(spark.read.parquet(path)) == [{"OrderNumber": 10, "LineNumber": 2}] * 2


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "TotalOrders" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "customer_metrics" in E.oracle_sql()


def test_smoke_every_query_sf0001(spark):
    """Every registered query plans and runs on the smallest scale factor."""
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        fn(spark, SF_SMOKE).write.format("noop").mode("overwrite").save()


def test_replace_and_append_catalog_table(spark):
    loc = tempfile.mkdtemp(prefix="shelfwise-db-", dir="/tmp")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shelfwise_test LOCATION '{loc}'")
    t = "shelfwise_test.product_forecasts"
    ingest.replace_table(spark.createDataFrame([(2, 1.0), (1, 2.0)], "ProductKey long, Week1Demand double"),
                         t, cluster_cols=["ProductKey"])
    assert sorted(r["ProductKey"] for r in rows(spark.table(t))) == [1, 2]
    # replacing takes the new schema (overwriteSchema semantics)
    ingest.replace_table(spark.createDataFrame([(3, 1.0, 4.0)], "ProductKey long, W1 double, W2 double"), t)
    assert spark.table(t).columns == ["ProductKey", "W1", "W2"] and spark.table(t).count() == 1
    ingest.append_table(spark.createDataFrame([(5.0, 2.0, 9)], "W2 double, W1 double, ProductKey long"), t)
    assert {r["ProductKey"]: r["W2"] for r in rows(spark.table(t))} == {3: 4.0, 9: 5.0}
    spark.sql("DROP DATABASE shelfwise_test CASCADE")


def test_shift_calendar_moves_every_day(spark):
    from shelfwise.plans import catalog
    from shelfwise.sources.binding import CALENDAR_END, CALENDAR_START
    got = catalog.q_shift_calendar(spark, SF_SMOKE).select("DateKey", "FullDateAlternateKey", "CalendarYear").collect()
    assert len(got) == (CALENDAR_END - CALENDAR_START).days + 1
    last = max(got, key=lambda r: r.DateKey)
    assert (last.FullDateAlternateKey, last.CalendarYear) == (dt.date(2041, 12, 31), 2041)
