"""Folders and files of any store that Spark reads, through the store's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make_folder(spark: SparkSession, folder: str) -> None:
    fs, p = _at(spark, folder)
    fs.mkdirs(p)


def create_empty(spark: SparkSession, path: str) -> None:
    """Create an empty file in one step; an error if it is there already."""
    fs, p = _at(spark, path)
    fs.create(p, False).close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, _at(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it; nothing happens if it is not there."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
