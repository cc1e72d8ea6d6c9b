"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def session_settings(master: str | None = None, shuffle_partitions: int | None = None,
                     driver_memory: str | None = None) -> dict[str, str]:
    """Settings that ``get_session`` puts on top of what the cluster configures."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # streams keep one entry per order line: on local disk with bounded memory, not in the heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    asked = {"spark.master": master, "spark.sql.shuffle.partitions": shuffle_partitions and str(shuffle_partitions),
             "spark.driver.memory": driver_memory}
    return settings | {key: value for key, value in asked.items() if value}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfwise", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators rely on.

    The master, the memory and the number of shuffle partitions come from the
    cluster (spark-submit, its defaults file) unless the caller passes them, as
    tests and the benchmark do.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in session_settings(master, shuffle_partitions, driver_memory).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


# rows of a fact that one shuffle task gets, and the compressed size up to which adaptive execution merges small tasks
ROWS_PER_TASK = 500_000
MERGE_UP_TO = "8m"
SHUFFLE_PARTITIONS, MERGE_SIZE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Raise the session's number of shuffle partitions so that a fact of ``rows`` rows gives a task ``ROWS_PER_TASK``.

    A fixed number makes a task's memory and reads grow with the tables. It is never lowered, and a merge size that the
    cluster chose stays; Spark's own default merges by compressed bytes, which hold very many narrow rows.
    """
    wanted = -(-rows // ROWS_PER_TASK)
    if wanted > int(spark.conf.get(SHUFFLE_PARTITIONS)):
        spark.conf.set(SHUFFLE_PARTITIONS, str(wanted))
    if wanted > 1 and spark.conf.get(MERGE_SIZE).lower() in ("64mb", "64m", "67108864", "67108864b"):
        spark.conf.set(MERGE_SIZE, MERGE_UP_TO)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local run without the setting gets a fresh scratch folder; on a cluster
    a folder that executors do not share would lose data, so there the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="shelfwise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def side_by_side(work: Callable, items: Iterable, at_a_time: int) -> list:
    """``work(item)`` of every item, a few at a time, so that independent jobs share the cluster; results in order.

    The threads inherit the caller's local properties (job group, scheduler pool).
    """
    spark, items = SparkSession.getActiveSession(), list(items)
    with ThreadPoolExecutor(max(1, min(at_a_time, len(items)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), item) for item in items]]
