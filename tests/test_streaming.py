"""The stream equals the batch, whatever stops or repeats."""

import threading

import pytest
from pyspark.sql import functions as F

from paperlode.config import FeedConfig
from paperlode.streaming import intake

SCHEMA = "id STRING, category STRING, updated TIMESTAMP, n INT"
CFG = FeedConfig(categories=("a", "b"))


def _work(rows):
    return rows.withColumns({
        "status": F.when(F.col("n") < 0, "failed").otherwise("ok"), "Paper Link": F.col("id"), "Dataset Link": F.lit("https://d.org/"),
        "Dataset Description": F.col("n").cast("string"), "Timestamp": F.date_format("updated", "yyyy-MM-dd"),
    })


def _batch(spark, *rows):
    data = [(i, c, f"2024-01-0{d} 00:00:00", n) for i, c, d, n in rows]
    return spark.createDataFrame(data, "id string, category string, u string, n int").select(
        "id", "category", F.col("u").cast("timestamp").alias("updated"), "n"
    )


@pytest.fixture
def tables(spark, tmp_path):
    return intake.create_state(spark, str(tmp_path / "state"))


def _seen(spark, tables):
    return sorted((r.id, r.category) for r in intake.seen(spark, tables).collect())


def test_owner_seen_and_retry(spark, tables):
    intake.process_batch(_batch(spark, ("x", "b", 1, 1), ("x", "a", 1, 2), ("y", "a", 1, -1)), 0, tables, _work, CFG)
    assert _seen(spark, tables) == [("x", "a")]
    intake.process_batch(_batch(spark, ("x", "b", 2, 5), ("y", "a", 2, 3)), 1, tables, _work, CFG)
    assert _seen(spark, tables) == [("x", "a"), ("y", "a")]
    records = sorted((r["Paper Link"], r.ledger_day, r["Dataset Description"]) for r in intake.ledger(spark, tables).collect())
    assert records == [("x", "2024-01-01", "2"), ("y", "2024-01-02", "3")]
    assert [r.last_updated.day for r in intake.progress(spark, tables).collect()] == [2]


def test_repeated_batch_changes_nothing(spark, tables):
    first = _batch(spark, ("x", "a", 1, 1))
    second = _batch(spark, ("x", "a", 1, 9), ("z", "b", 1, 4))
    intake.process_batch(first, 0, tables, _work, CFG)
    for _ in range(3):
        intake.process_batch(second, 1, tables, _work, CFG)
    assert _seen(spark, tables) == [("x", "a"), ("z", "b")]
    assert intake.ledger(spark, tables).count() == 2


def test_ledger_keeps_untouched_days_and_prefers_new(spark, tables):
    def records(*rows):
        return spark.createDataFrame(rows, "ledger_day string, `Paper Link` string, `Dataset Link` string, `Dataset Description` string, Timestamp string")

    intake.upsert_ledger(spark, tables, records(("d1", "p", "http://d", "old", "1"), ("d2", "p", "http://d", "two", "1")), 0)
    intake.upsert_ledger(spark, tables, records(("d1", "p", "https://D/", "new", "2"), ("d1", "q", "", "blank", "2")), 1)
    got = sorted((r.ledger_day, r["Dataset Description"]) for r in intake.ledger(spark, tables).collect())
    assert got == [("d1", "new"), ("d2", "two")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"i{k % 40}", "ab"[k % 2], 1 + k % 5, k) for k in range(200)]
    batch = _batch(spark, *rows)
    landing = str(tmp_path / "landing")
    for part in batch.randomSplit([1.0, 1.0, 1.0], 7):
        part.coalesce(1).write.mode("append").parquet(landing)
    batch.filter("n < 50").coalesce(1).write.mode("append").parquet(landing)
    streamed = intake.create_state(spark, str(tmp_path / "stream"))
    stream = intake.read_stream(spark, landing, SCHEMA, files=1)
    intake.start(stream, streamed, _work, CFG, ("n",), available_now=True).awaitTermination()
    whole = intake.create_state(spark, str(tmp_path / "whole"))
    intake.process_batch(batch, 0, whole, _work, CFG, ("n",))
    ids = lambda t: sorted(r.id for r in intake.seen(spark, t).collect())
    assert ids(streamed) == ids(whole)
    again = intake.start(stream, streamed, _work, CFG, ("n",), available_now=True)
    again.awaitTermination()
    assert ids(streamed) == ids(whole)


def test_late_repeats_are_dropped(spark, tmp_path):
    landing = str(tmp_path / "landing")
    df = _batch(spark, ("x", "a", 1, 1), ("y", "a", 2, 1))
    df.write.mode("append").parquet(landing)
    df.write.mode("append").parquet(landing)
    unique = intake.without_late_repeats(intake.read_stream(spark, landing, SCHEMA, files=1), 3)
    out = str(tmp_path / "out")
    unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(SCHEMA).parquet(out).count() == 2


def test_stop_on_request(spark, tmp_path):
    landing = str(tmp_path / "landing")
    _batch(spark, ("x", "a", 1, 1)).write.parquet(landing)
    tables = intake.create_state(spark, str(tmp_path / "state"))
    query = intake.start(intake.read_stream(spark, landing, SCHEMA), tables, _work, FeedConfig(categories=("a",), trigger="1 second"))
    stop = threading.Event()
    query.processAllAvailable()
    stop.set()
    intake.run_until(query, stop.is_set, 0.1)
    assert not query.isActive
    assert _seen(spark, tables) == [("x", "a")]
