"""Atomic replacement of tables by publishing versions.

A replacement is written to a fresh place first, as one distributed job; only when that job has
succeeded one metadata step makes it the current version. A job that fails half-way therefore leaves the
rows of the version before readable, and a reader that began before the switch finishes on the files it
began with, because the version before stays until the next but one replacement (``keep``).

Folders (``publish``, ``read_published``): ``root/<version>/`` holds the files of a version, the empty file
``root/_published/<version>`` makes it current. Its name is all there is to it, so creating it is one step in any
store. The current version is the last of the markers in name order. Two publishers that race for a number both succeed, and all
readers agree on the one that counts.

Catalog tables (``replace``, ``append``, ``drop``): every version is a table of its own, ``<name>__v<version>``,
and ``<name>`` is a view on the current one, switched by CREATE OR REPLACE VIEW, which takes over schema and
data together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources import files

MARKERS = "_published"
KEEP = 2
VERSION_PROPERTY = "shelfwise.version"


def new_version(known: list[str]) -> str:
    """A name that comes after all ``known`` version names."""
    last = max((int(v[:12]) for v in known), default=0)
    return f"{last + 1:012d}_{uuid.uuid4().hex[:12]}"


# ----------------------------------------------------------------- folders

def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions under ``root``, the current one last."""
    return [v for v in files.names(spark, f"{root.rstrip('/')}/{MARKERS}") if not v.startswith((".", "_"))]


def published_path(spark: SparkSession, root: str) -> str:
    """Folder of the current version; an error if nothing is published."""
    found = versions(spark, root)
    if not found:
        raise LookupError(f"nothing is published under {root}")
    return f"{root.rstrip('/')}/{found[-1]}"


def read_published(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The current version as it is now: a later publication does not change this frame."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(published_path(spark, root))


def publish(df: DataFrame, root: str, keep: int = KEEP) -> str:
    """Write ``df`` as a new version under ``root`` and make it current; returns its folder.

    ``df`` may read the version it replaces. The ``keep`` last versions stay, the new one included.
    """
    if keep < 1:
        raise ValueError("keep the current version at least")
    spark, root = df.sparkSession, root.rstrip("/")
    version = new_version(versions(spark, root))
    folder = f"{root}/{version}"
    try:
        df.write.parquet(folder)
    except BaseException:
        files.delete(spark, folder)  # this folder is this writer's alone
        raise
    files.create_empty(spark, f"{root}/{MARKERS}/{version}")
    for old in versions(spark, root)[:-keep]:
        files.delete(spark, f"{root}/{MARKERS}/{old}")  # the marker first: what has lost its files must not be found
        files.delete(spark, f"{root}/{old}")
    return folder


def swap_folder(df: DataFrame, path: str) -> None:
    """Overwrite a plain folder, for readers that know only its path: write aside, then exchange the two folders by renames.

    A failing job leaves the old rows where they are. Unlike ``publish`` this takes two steps, between which the folder
    is missing, and readers that began before lose their files.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    aside, old = f"{path}__new_{uuid.uuid4().hex}", f"{path}__old_{uuid.uuid4().hex}"
    try:
        df.write.parquet(aside)
    except BaseException:
        files.delete(spark, aside)
        raise
    files.rename(spark, path, old)
    files.rename(spark, aside, path)
    files.delete(spark, old)


# ---------------------------------------------------------- catalog tables

def _split(table: str) -> tuple[str, str]:
    """(database with a dot or nothing, name) of a possibly qualified table name."""
    database, dot, name = table.rpartition(".")
    return database + dot, name


def _quoted(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def _kind(spark: SparkSession, table: str) -> str | None:
    """VIEW, another table type, or None if there is no such table; a temporary view is an error, since it would hide a table."""
    kind = spark.catalog.getTable(table).tableType if spark.catalog.tableExists(table) else None
    if kind == "TEMPORARY":
        raise ValueError(f"{table} is a temporary view")
    return kind


def table_versions(spark: SparkSession, table: str) -> list[str]:
    """Version names of a published catalog table, oldest first."""
    database, name = _split(table)
    of = f"{name}__v".lower()
    found = spark.sql(f"SHOW TABLES {'IN ' + _quoted(database[:-1]) if database else ''}").collect()
    return sorted(r.tableName[len(of):] for r in found if r.tableName.lower().startswith(of) and r.tableName[len(of):len(of) + 12].isdigit())


def current_table(spark: SparkSession, table: str) -> str:
    """The table that holds the rows of ``table``: its current version, or itself if it is a plain table."""
    if _kind(spark, table) != "VIEW":
        return table
    found = spark.sql(f"SHOW TBLPROPERTIES {_quoted(table)}").where(f"key = '{VERSION_PROPERTY}'").collect()
    if not found:
        raise ValueError(f"{table} is a view that was not published by replace()")
    return found[0].value


def replace(df: DataFrame, table: str, keep: int = KEEP) -> None:
    """Make ``df`` the contents and the schema of catalog table ``table``; it may read the rows it replaces.

    A plain table of that name is taken over as the oldest version first (a rename, once).
    """
    if keep < 1:
        raise ValueError("keep the current version at least")
    spark = df.sparkSession
    current_table(spark, table)  # refuses views of other origin
    kind, version = _kind(spark, table), f"{table}__v{new_version(table_versions(spark, table))}"
    try:
        df.write.format("parquet").saveAsTable(version)
    except BaseException:
        database, name = _split(version)
        location = spark.catalog.getDatabase(database[:-1] or spark.catalog.currentDatabase()).locationUri
        files.delete(spark, f"{location.rstrip('/')}/{name}")  # what a failed job leaves is in no catalog
        raise
    if kind not in (None, "VIEW"):
        spark.sql(f"ALTER TABLE {_quoted(table)} RENAME TO {_quoted(f'{table}__v{0:012d}_{uuid.uuid4().hex[:12]}')}")
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(table)} TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version}') AS SELECT * FROM {_quoted(version)}")
    for old in table_versions(spark, table)[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{table}__v{old}')}")


def append(df: DataFrame, table: str) -> None:
    """Append rows by column name to the current version (one job: a failing one adds nothing)."""
    target = current_table(df.sparkSession, table)
    df.select(*df.sparkSession.table(target).columns).write.mode("append").format("parquet").saveAsTable(target)


def drop(spark: SparkSession, table: str) -> None:
    """Drop a published table with all its versions."""
    old = table_versions(spark, table)
    spark.sql(f"DROP {'VIEW' if _kind(spark, table) == 'VIEW' else 'TABLE'} IF EXISTS {_quoted(table)}")
    for version in old:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(f'{table}__v{version}')}")
