"""Publishing whole tables in two phases."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from dendra.sources import publish


def visible(path):
    return [p for p in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(p)]


def test_written_unchanged_refused(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(1000).select("id", F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("v"), F.when(F.col("id") % 3 == 0, F.array("id")).alias("a.b")).repartition(6)
    assert publish.publish_rows(rows, path) == "written"
    before = sorted(visible(path))
    assert sum("part-" in p for p in before) >= 6 - 1
    assert publish.publish_rows(rows.repartition(3, "id"), path) == "unchanged"
    for other in (rows.where("id <> 7"), rows.union(rows.limit(1)), rows.withColumn("v", F.when(F.col("id") != 7, F.col("v"))), rows.withColumnRenamed("v", "w"), rows.withColumn("id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("id")))):
        with pytest.raises(FileExistsError):
            publish.publish_rows(other, path)
    with pytest.raises(FileExistsError):
        publish.publish_rows(rows.drop("a.b"), path, "json")
    assert sorted(visible(path)) == before
    assert sorted(publish.read_published(spark, path).select("id", "v").collect()) == sorted(rows.select("id", "v").collect())


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(100).repartition(5).select(F.when(F.col("id") == 63, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        publish.publish_rows(rows, path)
    assert not [p for p in visible(path) if "part-" in p]
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path)
    assert publish.publish_rows(spark.range(100), path) == "written"
    assert publish.read_published(spark, path).count() == 100


def test_another_run_comes_first(spark, tmp_path, monkeypatch):
    """Both look before either has a manifest: the second finds it when it publishes, and gives way."""
    path = f"{tmp_path}/t"
    looks = []
    real = publish.manifest
    monkeypatch.setattr(publish, "manifest", lambda s, p: None if not looks.append(1) and len(looks) == 1 else real(s, p))
    publish.publish_rows(spark.range(5), f"{tmp_path}/other")
    for rows, outcome in ((spark.range(10), "written"), (spark.range(10).repartition(4), "unchanged"), (spark.range(11), FileExistsError)):
        looks.clear()
        if outcome is FileExistsError:
            with pytest.raises(FileExistsError):
                publish.publish_rows(rows, path)
        else:
            assert publish.publish_rows(rows, path) == outcome
    assert publish.read_published(spark, path).count() == 10 and len(glob.glob(f"{path}/_data-*")) == 1


def test_empty_and_text(spark, tmp_path):
    assert publish.publish_rows(spark.range(0), f"{tmp_path}/e") == "written" and publish.publish_rows(spark.range(0), f"{tmp_path}/e") == "unchanged"
    assert publish.read_published(spark, f"{tmp_path}/e").count() == 0
    lines = spark.createDataFrame([("a",), ("ü b",)], "value string")
    assert publish.publish_rows(lines, f"{tmp_path}/x", "text") == "written"
    assert sorted(r.value for r in publish.read_published(spark, f"{tmp_path}/x").collect()) == ["a", "ü b"]
