"""Audits from parquet footers: plans read no column, values agree with scans, cases that footers cannot answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.sources import footers
from shelfwise.sources.raw import read_table

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(spark, tmp_path):
    def write(name, df, parts=2):
        df.repartition(parts).write.parquet(f"{tmp_path}/{name}")
    return write, lambda session, name: session.read.parquet(f"{tmp_path}/{name}")


def audit(spark, read, *items):
    return {(r["table"], r["column"]): (r["max_value"], r["row_count"]) for r in footers.audit(spark, read, items).collect()}


def test_integer_and_date_maxima_read_no_column(spark, written):
    write, read = written
    write("days", spark.range(1000).select("id", F.date_add(F.lit(dt.date(2001, 1, 1)), F.col("id").cast("int") % 50).alias("day")), 5)
    own = footers.footer_session(spark)
    text = plan(footers.maxima(read(own, "days"), ["id", "day"]))
    assert "PushedAggregation: [MAX(id), MAX(day), COUNT(*)]" in text and "BatchScan" in text
    assert audit(spark, read, ("days", ["id", "day"])) == {("days", "id"): ("999", 1000), ("days", "day"): ("2001-02-19", 1000)}
    # the caller's own reads are as before
    assert "BatchScan" not in plan(footers.maxima(read(spark, "days"), ["id"]))


def test_audit_agrees_with_scans(spark):
    items = [("lineitem", ["l_orderkey", "l_shipdate", "l_linenumber"]), ("orders", ["o_orderdate"]), ("documents", ["doc_id", "lang"])]
    got = audit(spark, lambda session, t: read_table(session, SF, t), *items)
    for table, columns in items:
        df = read_table(spark, SF, table)
        for c in columns:
            assert got[table, c] == tuple(df.agg(F.max(c).cast("string"), F.count(F.lit(1))).first())


def test_empty_tables_null_columns_and_odd_names(spark, written):
    write, read = written
    write("none", spark.createDataFrame([], "id long, day date"))
    write("nulls", spark.range(10).select(F.lit(None).cast("int").alias("x"), "id"))
    write("mixed", spark.createDataFrame([(1, "a"), (None, "b"), (-7, None)], "row_count int, m0 string"), 3)
    got = audit(spark, read, ("none", ["id", "day"]), ("nulls", ["x", "id"]), ("mixed", ["row_count", "m0"]))
    assert got == {("none", "id"): (None, 0), ("none", "day"): (None, 0), ("nulls", "x"): (None, 10), ("nulls", "id"): ("9", 10),
                   ("mixed", "row_count"): ("1", 3), ("mixed", "m0"): ("b", 3)}


def test_missing_table_is_an_error(spark, written):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        audit(spark, written[1], ("absent", ["id"]))
