"""Returned order lines as a stream (S11 + T9 incrementally).

Sources: files of returned lines landing in a folder, and the files of the returns table itself, both
read as streams, so each file is read once. A keyed state (one entry per order line, in the state store) remembers
which lines the table holds; a micro-batch gets its lines' entries and reads nothing that is
stored. New lines are validated against the sales keys of the batch's order numbers with a left-semi join and
written with their return-email payloads.

Exactly once: a batch owns one folder per sink, ``stream=<id>/batch_id=<n>``, and overwrites
it. The stream id comes from the query's checkpoint, so a replay after a crash at any point
rewrites the same folders, and a second query into the same tables has folders of its own; it learns of the lines of the first
from the table's files. A line counts as returned once it is in the table: one that failed validation may be sent again.
Two queries that get the same new line before either has written it both write it. The caller names
the checkpoint: without a lasting one a restart could not know what it has read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators import text
from shelfwise.operators.ranking import materialize
from shelfwise.sources import files

RETURN_SCHEMA = "OrderNumber long, LineNumber int"


def stream_id(checkpoint: str) -> str:
    """Name of a stream's folders, the same for every run over the same checkpoint."""
    return "s" + uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex


def _order_range(keys: DataFrame) -> tuple[int, int] | None:
    """Smallest and largest order number; None without a row."""
    low, high = keys.agg(F.min("OrderNumber"), F.max("OrderNumber")).first()
    return None if low is None else (low, high)


def process_batch(batch: DataFrame, batch_id: int, stream: str, sales_keys: DataFrame, sales_view: DataFrame,
                  returns_path: str, payload_path: str) -> None:
    """Validate one micro-batch of new returns and write it and its e-mail payloads to the batch's own folders.

    The sales are read between the batch's smallest and largest order number only: a range filter that reaches the scan, and
    skips files where sales are clustered by order. A batch without a new line writes nothing, but for the first, which makes the tables.
    """
    lines = materialize(batch.select("OrderNumber", "LineNumber").distinct())
    orders = _order_range(lines)
    if orders is None and batch_id > 0:
        return
    low, high = orders or (0, -1)
    valid = materialize(lines.join(sales_keys.where(F.col("OrderNumber").between(low, high)), ["OrderNumber", "LineNumber"], "left_semi"))
    folder = f"stream={stream}/batch_id={batch_id}"
    # payloads first: while the returns are missing, a replay finds the lines new and writes both again
    sold = sales_view.where(F.col("SalesOrderNumber").between(low, high))
    text.return_email_json(sold, valid).write.mode("overwrite").parquet(f"{payload_path}/{folder}")
    valid.write.mode("overwrite").parquet(f"{returns_path}/{folder}")


def new_lines(spark: SparkSession, landing_dir: str, returns_path: str) -> DataFrame:
    """Streaming (OrderNumber, LineNumber, stored) in update mode: the lines of each micro-batch, and whether the table holds them."""
    landing = spark.readStream.schema(RETURN_SCHEMA).parquet(landing_dir)
    files.make_folder(spark, returns_path)
    # a replayed batch replaces files that may have been listed before; their lines stand in the new ones
    table = spark.readStream.schema(RETURN_SCHEMA).option("ignoreMissingFiles", "true").parquet(returns_path)
    events = landing.withColumn("stored", F.lit(False)).unionByName(table.select("OrderNumber", "LineNumber").withColumn("stored", F.lit(True)))
    return events.groupBy("OrderNumber", "LineNumber").agg(F.max("stored").alias("stored"))


def start_returns_stream(spark: SparkSession, landing_dir: str, sales_view: DataFrame,
                         returns_path: str, payload_path: str, checkpoint: str,
                         trigger_seconds: int | None = None) -> StreamingQuery:
    """Start the returns stream over parquet files arriving in ``landing_dir``."""
    stream = stream_id(checkpoint)
    keys = sales_view.select(F.col("SalesOrderNumber").alias("OrderNumber"),
                             F.col("SalesOrderLineNumber").alias("LineNumber"))

    def write(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch.where(~F.col("stored")), batch_id, stream, keys, sales_view, returns_path, payload_path)

    w = new_lines(spark, landing_dir, returns_path).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)
    return w.start()
