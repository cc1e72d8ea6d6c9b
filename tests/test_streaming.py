import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from shelfwise.streaming import returns


def _view(spark):
    return spark.createDataFrame(
        [(1, 10, 1, "a@x", "A", "B", "Bike", 2, 5.0), (1, 10, 2, "a@x", "A", "B", "Helmet", 1, 2.5),
         (2, 11, 1, "b@x", "C", "D", "Bike", 1, 5.0)],
        "CustomerKey long, SalesOrderNumber long, SalesOrderLineNumber int, EmailAddress string, "
        "FirstName string, LastName string, EnglishProductName string, OrderQuantity int, UnitPrice double")


def test_batch_replay_is_idempotent_and_validates(spark):
    root = tempfile.mkdtemp(prefix="shelfwise-stream-", dir="/tmp")
    ret_path, pay_path = os.path.join(root, "returns"), os.path.join(root, "payloads")
    view = _view(spark)
    keys = view.select(F.col("SalesOrderNumber").alias("OrderNumber"),
                       F.col("SalesOrderLineNumber").alias("LineNumber"))
    batch = spark.createDataFrame([(10, 2), (10, 2), (99, 1)], returns.RETURN_SCHEMA)  # dup + unknown line
    returns.process_batch(batch, 0, "s1", keys, view, ret_path, pay_path)
    returns.process_batch(batch, 0, "s1", keys, view, ret_path, pay_path)  # replay: the same folders again
    got = rows(spark.read.parquet(ret_path))
    assert got == [{"OrderNumber": 10, "LineNumber": 2, "stream": "s1", "batch_id": 0}]
    pay = rows(spark.read.parquet(pay_path))
    assert len(pay) == 1 and '"EnglishProductName":"Helmet"' in pay[0]["json_string"]


def test_second_stream_resent_lines_and_crash_between_the_writes(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="shelfwise-stream-", dir="/tmp")
    ret_path, pay_path = os.path.join(root, "returns"), os.path.join(root, "payloads")
    view = _view(spark)
    lines = {"a": [(10, 1)], "b": [(11, 1), (10, 1)]}
    for name, data in lines.items():  # two queries, each starting at batch 0, into the same tables
        landing = os.path.join(root, f"landing-{name}")
        spark.createDataFrame(data, returns.RETURN_SCHEMA).write.parquet(landing)
        returns.start_returns_stream(spark, landing, view, ret_path, pay_path, os.path.join(root, f"ckpt-{name}")).awaitTermination()
    stored = sorted((r["OrderNumber"], r["LineNumber"]) for r in rows(spark.read.parquet(ret_path)))
    assert stored == [(10, 1), (11, 1)]  # nothing skipped, the resent line neither stored nor mailed again
    assert spark.read.parquet(pay_path).count() == 2
    keys = view.select(F.col("SalesOrderNumber").alias("OrderNumber"), F.col("SalesOrderLineNumber").alias("LineNumber"))
    batch = spark.createDataFrame([(10, 2)], returns.RETURN_SCHEMA)
    whole = returns.text.return_email_json
    monkeypatch.setattr(returns.text, "return_email_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    try:
        returns.process_batch(batch, 7, "s9", keys, view, ret_path, pay_path)
        raise AssertionError("the write should have failed")
    except OSError:
        monkeypatch.setattr(returns.text, "return_email_json", whole)
    returns.process_batch(batch, 7, "s9", keys, view, ret_path, pay_path)
    assert spark.read.parquet(ret_path).where("stream = 's9'").count() == 1
    assert spark.read.parquet(pay_path).where("stream = 's9'").count() == 1


def test_stream_end_to_end_available_now(spark):
    root = tempfile.mkdtemp(prefix="shelfwise-stream-", dir="/tmp")
    landing = os.path.join(root, "landing")
    spark.createDataFrame([(11, 1)], returns.RETURN_SCHEMA).write.parquet(landing)
    q = returns.start_returns_stream(spark, landing, _view(spark), os.path.join(root, "r"), os.path.join(root, "p"),
                                     checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination()
    assert [r["OrderNumber"] for r in rows(spark.read.parquet(os.path.join(root, "r")))] == [11]


def test_later_batches_read_no_stored_return(spark):
    """Lines sent again by later files and by a second query are known from the state; files are read once; invalid lines may come again."""
    root = tempfile.mkdtemp(prefix="shelfwise-stream-", dir="/tmp")
    landing, ret_path, pay_path = (os.path.join(root, n) for n in ("landing", "returns", "payloads"))
    sold = _view(spark)
    seen = []

    def run(lines, view=sold, name="ckpt"):
        spark.createDataFrame(lines, returns.RETURN_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        q = returns.start_returns_stream(spark, landing, view, ret_path, pay_path, os.path.join(root, name))
        q.awaitTermination()
        seen.append([[s["numInputRows"] for s in p["sources"]] for p in q.recentProgress if p["numInputRows"]])
        return sorted((r["OrderNumber"], r["LineNumber"]) for r in rows(spark.read.parquet(ret_path)))

    assert run([(10, 1), (10, 1), (99, 1)]) == [(10, 1)]
    assert run([(10, 1), (11, 1)]) == [(10, 1), (11, 1)]
    late = sold.unionByName(sold.limit(1).withColumn("SalesOrderNumber", F.lit(99).cast("long")).withColumn("SalesOrderLineNumber", F.lit(1)))
    assert run([(99, 1), (11, 1)], late) == [(10, 1), (11, 1), (99, 1)]  # (99, 1) was refused before its sale arrived
    # each run reads the new landing file and what the table got since, never the whole table
    assert seen[0] == [[3, 0]] and seen[1] == [[2, 1]] and seen[2] == [[2, 1]]
    assert run([(10, 2)], sold, "other") == [(10, 1), (10, 2), (11, 1), (99, 1)]  # a second query, from the start of the landing folder
    assert spark.read.parquet(pay_path).count() == 4


def test_batch_append_is_idempotent_by_key(spark):
    from shelfwise.sources import ingest
    path = os.path.join(tempfile.mkdtemp(prefix="shelfwise-stream-", dir="/tmp"), "returns")
    sales = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "SalesOrderNumber long, SalesOrderLineNumber int")
    first = spark.createDataFrame([(10, 1), (10, 1), (77, 1)], returns.RETURN_SCHEMA)
    second = spark.createDataFrame([(10, 1), (11, 1)], returns.RETURN_SCHEMA)
    for _ in range(2):
        stored = ingest.append_returns(first, sales, path, batch="2024-01-01")
        assert rows(stored) == [{"OrderNumber": 10, "LineNumber": 1}]
    for _ in range(2):
        ingest.append_returns(second, sales, path, batch="b2")
    got = sorted((r["OrderNumber"], r["LineNumber"], str(r["batch"])) for r in rows(spark.read.schema(
        "OrderNumber long, LineNumber int, batch string").parquet(path)))
    assert got == [(10, 1, "2024-01-01"), (11, 1, "b2")]
