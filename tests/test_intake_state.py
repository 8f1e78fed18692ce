"""State of the intake: flat reads, commits of all sinks together, look-back, compaction and clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from paperlode.config import FeedConfig
from paperlode.streaming import intake
from paperlode.streaming.commits import Commits, Record

CFG = FeedConfig(categories=("a", "b"), look_back_days=3)


def _work(rows):
    return rows.withColumns({
        "status": F.when(F.col("n") < 0, "failed").otherwise("ok"), "Paper Link": F.concat(F.lit("https://p/"), "id"), "Dataset Link": F.lit("https://d.org/"),
        "Dataset Description": F.col("n").cast("string"), "Timestamp": F.date_format("updated", "yyyy-MM-dd"),
    })


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id string, category string, u string, n int").select(
        "id", "category", F.col("u").cast("timestamp").alias("updated"), "n"
    )


def _day(spark, k, ids=12):
    """Entries of day k, and those of the day before again."""
    data = [(f"d{d}-{i}", "ab"[i % 2], f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 0{i % 9}:00:00", i) for d in (k - 1, k) if d >= 0 for i in range(ids)]
    return _rows(spark, data)


@pytest.fixture
def tables(spark, tmp_path):
    return intake.create_state(spark, str(tmp_path / "state"))


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_fifty_batches_read_no_more_than_ten(spark, tables):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k in range(50):
            intake.process_batch(_day(spark, k), k, tables, _work, CFG, ("n",))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    commits = Commits(spark, tables.commits)
    records = [commits.read(k) for k in range(50)]
    read = [r.state_bytes for r in records]
    assert max(read[30:]) <= 1.1 * max(read[10:30]) and min(read[10:]) > 0
    assert all(r.rows == 12 for r in records)  # the repeats of the day before are known
    assert max(len(r.seen) for r in records) == intake.COMPACT and sum(len(r.seen) == 1 for r in records) >= 5
    assert intake.seen(spark, tables).count() == 600 == intake.ledger(spark, tables).count()
    assert intake.seen_ids(spark, tables, records[-1], list(range(intake.BUCKETS))).count() < 200
    assert sorted(r.category for r in intake.progress(spark, tables).collect()) == ["a", "b"]
    versions = os.listdir(tables.seen)
    gone = intake.vacuum(spark, tables)
    assert len(gone) > 30 and len(os.listdir(tables.seen)) < len(versions)
    assert intake.ledger(spark, tables).count() == 600
    intake.process_batch(_day(spark, 50), 50, tables, _work, CFG, ("n",))
    assert commits.read(50).rows == 12


def test_nothing_is_visible_before_the_commit(spark, tables, monkeypatch):
    intake.process_batch(_day(spark, 0), 0, tables, _work, CFG, ("n",))

    def state():
        return (
            sorted(r.id for r in intake.seen(spark, tables).collect()), sorted(tuple(r) for r in intake.ledger(spark, tables).collect()),
            sorted(tuple(r) for r in intake.progress(spark, tables).collect()), intake.results(spark, tables).count(),
        )

    first = state()
    # It stops after each of the writes in turn: the work, the seen ids, the ledger, the record.
    for place, name in ((intake, "_write_seen"), (intake, "write_days"), (Commits, "write")):
        with monkeypatch.context() as m:
            m.setattr(place, name, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                intake.process_batch(_day(spark, 1), 1, tables, _work, CFG, ("n",))
        assert state() == first
    intake.process_batch(_day(spark, 1), 1, tables, _work, CFG, ("n",))
    second = state()
    assert len(second[0]) == 24 and second[3] == 24
    done = []
    intake.process_batch(_day(spark, 1), 1, tables, lambda rows: done.append(1) or _work(rows), CFG, ("n",))
    assert state() == second and not done  # a committed batch is not worked on again


def test_look_back_and_target_day(spark, tables):
    old, new = ("x", "a", "2024-01-01 00:00:00", 1), ("y", "a", "2024-01-09 00:00:00", 2)
    intake.process_batch(_rows(spark, [old, new, ("z", "a", None, 3)]), 0, tables, _work, CFG, ("n",))
    assert [r.id for r in intake.seen(spark, tables).collect()] == ["y"]
    assert Commits(spark, tables.commits).read(0).late == 2
    day = FeedConfig(categories=("a",), look_back_days=None, target_day="2024-01-01")
    intake.process_batch(_rows(spark, [old, ("w", "a", "2024-01-02 00:00:00", 1)]), 1, tables, _work, day, ("n",))
    assert sorted(r.id for r in intake.seen(spark, tables).collect()) == ["x", "y"]


def test_empty_batch_and_empty_state(spark, tables):
    assert intake.ledger(spark, tables).collect() == [] and intake.progress(spark, tables).collect() == []
    intake.process_batch(_rows(spark, [("x", "a", "2024-01-01 00:00:00", 1)]).filter("false"), 0, tables, _work, CFG, ("n",))
    assert Commits(spark, tables.commits).read(0) == Record(0, None, (0,))
    assert intake.seen(spark, tables).collect() == []
