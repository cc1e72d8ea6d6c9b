"""Replacements that fail, and readers that began before a replacement."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shelfwise.sources import files, ingest, publish


def _root(name):
    return os.path.join(tempfile.mkdtemp(prefix="shelfwise-publish-", dir="/tmp"), name)


def _failing(spark, after=500):
    """A query that has written some partitions' rows when it fails."""
    return spark.range(0, 1000, 1, 4).select(F.when(F.col("id") > after, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("long").alias("id"))


def _ids(df):
    return sorted(r["id"] for r in rows(df))


def test_published_folder_survives_a_failing_replacement(spark):
    root = _root("t")
    with pytest.raises(LookupError):
        publish.read_published(spark, root)
    with pytest.raises(Exception, match="half-way"):
        publish.publish(_failing(spark), root)
    with pytest.raises(LookupError):
        publish.published_path(spark, root)
    publish.publish(spark.range(5), root)
    with pytest.raises(Exception, match="half-way"):
        publish.publish(_failing(spark), root)
    assert _ids(publish.read_published(spark, root)) == [0, 1, 2, 3, 4]
    # nothing of the failed version is left
    assert len(files.names(spark, root)) == 2 and len(publish.versions(spark, root)) == 1


def test_reader_that_began_before_the_switch_finishes(spark):
    root = _root("t")
    publish.publish(spark.range(5), root)
    before = publish.read_published(spark, root)  # planned, not read yet
    publish.publish(before.select((F.col("id") + 10).alias("id"), F.lit("x").alias("more")), root)  # reads what it replaces
    assert _ids(before) == [0, 1, 2, 3, 4]
    now = publish.read_published(spark, root)
    assert now.columns == ["id", "more"] and _ids(now) == [10, 11, 12, 13, 14]
    publish.publish(spark.range(1), root)
    assert len(publish.versions(spark, root)) == publish.KEEP
    assert len(files.names(spark, root)) == publish.KEEP + 1  # the markers' folder too
    assert _ids(now) == [10, 11, 12, 13, 14]


def test_racing_publishers_agree(spark):
    root = _root("t")
    publish.publish(spark.range(1), root)
    for name in ("000000000002_bbbb", "000000000002_aaaa"):  # two writers that both saw version 1
        spark.range(2 if "a" in name else 3).write.parquet(f"{root}/{name}")
        files.create_empty(spark, f"{root}/{publish.MARKERS}/{name}")
    assert publish.published_path(spark, root).endswith("bbbb") and publish.read_published(spark, root).count() == 3
    publish.publish(spark.range(4), root)
    assert publish.versions(spark, root)[-1].startswith("000000000003_")


def test_marker_is_created_once(spark):
    path = _root("marker")
    files.create_empty(spark, path)
    with pytest.raises(Exception):
        files.create_empty(spark, path)


def test_plain_folder_keeps_its_rows_when_the_overwrite_fails(spark):
    path = _root("plain")
    ingest.write_clustered(spark.range(5), ["id"], path)
    for keys in (["id"], ["k"]):  # fails while ranges are sampled, or later in the write itself
        bad = _failing(spark).withColumn("k", F.lit(1)) if keys == ["k"] else _failing(spark)
        with pytest.raises(Exception, match="half-way"):
            ingest.write_clustered(bad, keys, path)
        assert _ids(spark.read.parquet(path)) == [0, 1, 2, 3, 4]
    ingest.write_clustered(spark.range(2).withColumn("x", F.lit(1)), ["id"], path)
    assert spark.read.parquet(path).columns == ["id", "x"] and _ids(spark.read.parquet(path)) == [0, 1]
    assert files.names(spark, os.path.dirname(path)) == ["plain"]


def test_catalog_table_survives_a_failing_replacement(spark):
    t = f"shelfwise_pub_{uuid.uuid4().hex}"
    ingest.replace_table(spark.range(5), t)
    before = spark.table(t)
    with pytest.raises(Exception, match="half-way"):
        ingest.replace_table(_failing(spark), t)
    assert _ids(spark.table(t)) == [0, 1, 2, 3, 4] and len(publish.table_versions(spark, t)) == 1
    location = spark.catalog.getDatabase(spark.catalog.currentDatabase()).locationUri
    assert len([n for n in files.names(spark, location) if n.startswith(t)]) == 1  # the failed version has left no files
    ingest.replace_table(spark.table(t).select((F.col("id") * 2).alias("id"), F.lit(1).alias("y")), t, ["id"])
    assert spark.table(t).columns == ["id", "y"] and _ids(spark.table(t)) == [0, 2, 4, 6, 8]
    assert _ids(before) == [0, 1, 2, 3, 4]  # planned before the switch
    ingest.append_table(spark.createDataFrame([(7, 100)], "y int, id long"), t)
    with pytest.raises(Exception, match="half-way"):
        ingest.append_table(_failing(spark).withColumn("y", F.lit(1)), t)
    assert _ids(spark.table(t)) == [0, 2, 4, 6, 8, 100]
    ingest.replace_table(spark.range(1), t)
    assert len(publish.table_versions(spark, t)) == publish.KEEP
    publish.drop(spark, t)
    assert not spark.catalog.tableExists(t) and publish.table_versions(spark, t) == []


def test_plain_catalog_table_is_taken_over(spark):
    t = f"shelfwise_pub_{uuid.uuid4().hex}"
    spark.range(3).write.saveAsTable(t)
    ingest.append_table(spark.range(3, 4), t)  # still a plain table
    with pytest.raises(Exception, match="half-way"):
        ingest.replace_table(_failing(spark), t)
    assert _ids(spark.table(t)) == [0, 1, 2, 3]
    ingest.replace_table(spark.table(t).where("id > 0"), t)
    assert _ids(spark.table(t)) == [1, 2, 3] and publish.current_table(spark, t).startswith(f"{t}__v000000000")
    publish.drop(spark, t)


def test_views_of_others_are_refused(spark):
    spark.range(1).createOrReplaceTempView("shelfwise_temp_view")
    for change in (ingest.append_table, ingest.replace_table):
        with pytest.raises(ValueError, match="temporary"):
            change(spark.range(1), "shelfwise_temp_view")
    t = f"shelfwise_pub_{uuid.uuid4().hex}"
    spark.range(1).write.saveAsTable(t)
    spark.sql(f"CREATE VIEW {t}_view AS SELECT * FROM {t}")
    for change in (ingest.append_table, ingest.replace_table):
        with pytest.raises(ValueError, match="not published"):
            change(spark.range(1), f"{t}_view")
    spark.sql(f"DROP VIEW {t}_view")
    publish.drop(spark, t)


def test_ingest_again_replaces_table_by_table(spark):
    root = _root("warehouse")
    catalog = {"FactThing": "id", "DimOther": "id"}
    for n in (3, 5):
        recon = rows(ingest.ingest(spark, lambda t: spark.range(n), root, catalog=catalog, versioned=True))
        assert {r["table"]: r["pre_count"] for r in recon} == {"fact_thing": n, "dim_other": n}
        assert _ids(publish.read_published(spark, f"{root}/fact_thing")) == list(range(n))
    with pytest.raises(Exception, match="half-way"):
        ingest.ingest(spark, lambda t: _failing(spark), root, catalog=catalog, versioned=True)
    assert all(r["same_content"] for r in rows(ingest.verify_roundtrip(spark, lambda t: spark.range(5), root, catalog, versioned=True)))
