"""Bucketed facts: joins, groupings and semi joins on the key without an exchange, with the rows of plain tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import catalog
from shelfwise.sources.colocate import write_bucketed

SF = "/root/testdata/sf0.001"
KEYS = ["o", "l"]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def bucketed(spark, tmp_path, df, buckets=4):
    name = f"t_{uuid.uuid4().hex}"
    return write_bucketed(df, name, f"{tmp_path}/{name}", KEYS, buckets)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_joins_on_the_key_need_no_exchange(spark, tmp_path, no_broadcast):
    a = spark.range(500).select((F.col("id") / 3).cast("long").alias("o"), (F.col("id") % 3).cast("int").alias("l"), F.col("id").alias("a"))
    b = a.where("a % 2 = 0").select("o", "l", (F.col("a") * 10).alias("b")).union(spark.createDataFrame([(None, 1, 7), (900, 0, 8)], "o long, l int, b long"))
    one, two = bucketed(spark, tmp_path, a), bucketed(spark, tmp_path, b)
    for how in ("left", "inner", "full", "left_semi", "left_anti"):
        joined = one.join(two, KEYS, how)
        assert "Exchange" not in executed(joined), how
        assert rows(joined) == rows(a.join(b, KEYS, how)), how
    grouped = two.groupBy(*KEYS).agg(F.sum("b").alias("b"))
    assert "Exchange" not in executed(grouped) and rows(grouped) == rows(b)
    # another number of buckets costs an exchange, not rows
    three = bucketed(spark, tmp_path, b, buckets=3)
    assert rows(one.join(three, KEYS)) == rows(a.join(b, KEYS))


def test_one_file_per_bucket_empty_and_existing_tables(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("o"), F.lit(1).alias("l"))
    t = bucketed(spark, tmp_path, df, buckets=4)
    assert t.select(F.input_file_name()).distinct().count() == 4 and t.count() == 1000
    assert bucketed(spark, tmp_path, df.where("false")).collect() == []
    name = f"t_{uuid.uuid4().hex}"
    write_bucketed(df, name, f"{tmp_path}/{name}", KEYS, 2)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
        write_bucketed(df.where("false"), name, f"{tmp_path}/{name}", KEYS, 2)
    assert spark.table(name).count() == 1000


def test_sales_reasons_meet_sales_without_an_exchange(spark, no_broadcast):
    got = catalog.q_sales_reason_colocated(spark, SF)
    text = executed(got)
    assert text.count("Bucketed: true") == 2, text
    # the one shuffle of the plain view's fact join is gone: no exchange on the order number is left
    assert "hashpartitioning(SalesOrderNumber" not in text, text
    want = catalog.q_star_sales_reason(spark, SF)
    assert rows(got.select(*want.columns)) == rows(want)
