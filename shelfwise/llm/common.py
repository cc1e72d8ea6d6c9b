"""Helpers shared by the training-data operators: inputs, scratch tables, slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir

HASH_BUCKETS = 1 << 40
SLICE_ROWS = 512
#: for tables whose rows are blocks of up to megabytes: a reader holds up to 4,096 rows of a row group in memory at once, a writer all of a page
WIDE_ROWS = {"parquet.block.row.count.limit": "16", "parquet.page.size.row.check.min": "1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one input table; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive any executor; several consumers
    of the result then read the files instead of repeating the work. ``wide``: rows are blocks (see ``WIDE_ROWS``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**WIDE_ROWS if wide else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` to a fresh folder of the shared scratch folder; returns its path, for a later ``delete_path``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written by ``write_scratch``, of the given schema even where no row was written."""
    return spark.read.schema(schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the store that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_memory() -> None:
    """Give a finished task's memory back: workers are reused, and what one stage leaves would pile up on the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that Python objects exist for few texts at a time; memory is given back at the end."""
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
    finally:
        release_memory()


def fold(column: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
