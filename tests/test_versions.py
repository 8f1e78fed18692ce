"""Writes become visible whole or not at all."""

import pytest
from pyspark.sql import functions as F

from paperlode.sources import sinks, versions

SCHEMA = "id string, day string, category string"


def _rows(spark, path):
    return sorted(tuple(r) for r in sinks.read_metadata(spark, path, "id STRING").collect())


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_task_that_dies_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [("1", "d1", "c"), ("2", "d2", "c")]
    sinks.write_metadata(_frame(spark, old), path)
    # The first task has written its partition when the second one dies.
    doomed = spark.range(0, 2, 1, 2).select(
        F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.lit("9")).cast("string").alias("id"), F.lit("d1").alias("day"), F.lit("c").alias("category")
    )
    with pytest.raises(Exception, match="lost"):
        sinks.write_metadata(doomed, path)
    assert _rows(spark, path) == old


def test_a_driver_that_dies_in_front_of_the_commit_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old = [("1", "d1", "c"), ("2", "d2", "c")]
    sinks.write_metadata(_frame(spark, old), path)

    def dies(self, change):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions.Versions, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_metadata(_frame(spark, [("9", "d1", "c"), ("9", "d3", "c")]), path)
    assert _rows(spark, path) == old
    # The files are there, and go with the next clean-up; those in use stay.
    table = versions.Versions(spark, path)
    assert len(list((tmp_path / "t").glob("paperlode_version=*"))) == 2
    assert table.clean() == []
    assert len(table.clean(older_than=-60)) == 1
    assert _rows(spark, path) == old


def test_two_writers_at_once_both_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.write_metadata(_frame(spark, [("1", "d1", "c"), ("2", "d2", "c")]), path)
    numbers, raced = versions.Versions.numbers, []

    def overtaken(self):
        found = numbers(self)
        if not raced:
            raced.append(True)
            sinks.write_metadata(_frame(spark, [("other", "d2", "c")]), path)
        return found

    monkeypatch.setattr(versions.Versions, "numbers", overtaken)
    sinks.write_metadata(_frame(spark, [("mine", "d1", "c")]), path)
    assert _rows(spark, path) == [("mine", "d1", "c"), ("other", "d2", "c")]
    assert numbers(versions.Versions(spark, path)) == [0, 1, 2]


def test_replace_append_cover_and_earlier_records(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.Versions(spark, path).parts() == {} and _rows(spark, path) == []
    odd = "2025-10-15（7） a/b=c [x]{y}*"
    sinks.append_samples(_frame(spark, [("1", odd, "c"), ("2", "d2", "c")]), path)
    sinks.append_samples(_frame(spark, [("3", odd, "c")]), path)
    assert _rows(spark, path) == [("1", odd, "c"), ("2", "d2", "c"), ("3", odd, "c")]
    sinks.write_metadata(_frame(spark, [("4", "d2", "c")]), path, [(odd, "c"), ("d9", "c")])
    assert _rows(spark, path) == [("4", "d2", "c")]
    first = versions.read_version(spark, path, "id STRING", "json", ["day", "category"], 0)
    assert sorted(r.id for r in first.collect()) == ["1", "2"]
    assert len(versions.Versions(spark, path).clean(keep=1, older_than=-60)) == 2
    assert _rows(spark, path) == [("4", "d2", "c")]


def test_null_keys_empty_writes_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_metadata(_frame(spark, [("1", None, "c"), ("2", "d2", None)]), path)
    sinks.write_metadata(_frame(spark, []), path)
    found = sinks.read_metadata(spark, path, "id STRING")
    assert sorted((r.id, r.day or "", r.category or "") for r in found.collect()) == [("1", "", "c"), ("2", "d2", "")]
    plan = found.filter("day = 'd2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and found.filter("day = 'd2'").count() == 1


def test_a_table_without_keys_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_csv(spark.createDataFrame([("a", 1), ("b,c", 2)], "k string, n int"), path)
    sinks.write_csv(spark.createDataFrame([("b,c\"", 3)], "k string, n int"), path)
    assert [tuple(r) for r in sinks.read_csv(spark, path, "k STRING, n INT").collect()] == [("b,c\"", 3)]
