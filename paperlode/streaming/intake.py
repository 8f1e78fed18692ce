"""Continuous intake: landed entries in, ledger, stage records and seen ids out, one idempotent micro-batch at a time.

State lies in tables below one shared folder; every batch writes its own versions and then one commit record
(:mod:`paperlode.streaming.commits`) that makes them current together. A batch that stops half-way leaves nothing visible
and may be repeated; a batch that is committed is not worked on again.

What a batch reads does not grow with the history: seen ids are kept by hash bucket, only for the look-back span, and
compacted every few batches; a ledger day is read through the pointer to its current version; progress is in the record.
Only the views for reports (:func:`results`, :func:`seen`) read all batches.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlode import rules, schemas
from paperlode.config import FeedConfig
from paperlode.functions.basic import not_blank
from paperlode.functions.urls import norm_url
from paperlode.operators.filters import category_rank, on_day, one_owner, unseen
from paperlode.operators.ranks import first_rows
from paperlode.streaming.commits import Commits, Record

#: Entry columns of a result; those of a stage record, null where the work has none; the ledger fields.
SEEN = "id STRING, category STRING, status STRING, updated TIMESTAMP"
STAGE = "gate_prob DOUBLE, description STRING, described BOOLEAN"
STAGED = SEEN + ", " + STAGE + ", " + schemas.LEDGER

#: Hash buckets of the seen ids, and the number of batches after which their versions become one.
BUCKETS, COMPACT = 16, 8
_SEEN_IDS = "id STRING, updated TIMESTAMP"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class StateTables:
    """Folders of the state of one intake."""

    root: str

    @property
    def results(self) -> str:
        return self.root + "/results"

    @property
    def ledger(self) -> str:
        return self.root + "/ledger"

    @property
    def seen(self) -> str:
        return self.root + "/seen"

    @property
    def commits(self) -> str:
        return self.root + "/commits"

    @property
    def checkpoint(self) -> str:
        return self.root + "/checkpoint"

    def day(self, day: str, batch_id: int) -> str:
        return f"{self.ledger}/batch_id={batch_id}/ledger_day={day}"


def create_state(spark: SparkSession, root: str) -> StateTables:
    """The folders of a new intake; an existing one is left as it is."""
    tables = StateTables(root)
    start = spark.createDataFrame([], STAGED)
    start.write.mode("ignore").parquet(f"{tables.results}/batch_id=-1")
    return tables


def read_stream(spark: SparkSession, path: str, schema: str, files: int | None = None, kind: str = "parquet") -> DataFrame:
    """Landed files as a stream, oldest first; ``files`` bounds one batch, else it takes all that is new."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def without_late_repeats(stream: DataFrame, days: int, time_column: str = "updated") -> DataFrame:
    """Bounded-state form of the look-back: repeats within ``days`` of event time are dropped."""
    return stream.withWatermark(time_column, f"{days} days").dropDuplicatesWithinWatermark(["id"])


# --- state views -------------------------------------------------------------------------------


def results(spark: SparkSession, tables: StateTables, before: int | None = None) -> DataFrame:
    """Every processed row of committed batches with its status and stage record."""
    done = Commits(spark, tables.commits).latest(before).batch_id
    rows = spark.read.schema(STAGED + ", batch_id LONG").option("ignoreMissingFiles", True).parquet(tables.results)
    return rows.filter(F.col("batch_id") <= done)


def seen(spark: SparkSession, tables: StateTables, before: int | None = None) -> DataFrame:
    """Ids that succeeded in any category; failed rows stay out and so return with the look-back."""
    return results(spark, tables, before).filter("status = 'ok'").select("id", "category", "updated", "batch_id")


def progress(spark: SparkSession, tables: StateTables, before: int | None = None) -> DataFrame:
    """Latest finished update per category; it never moves back."""
    marks = Commits(spark, tables.commits).latest(before).progress
    rows = spark.createDataFrame(list(marks.items()), "category STRING, micros LONG")
    return rows.select("category", F.timestamp_micros("micros").alias("last_updated"))


def ledger(spark: SparkSession, tables: StateTables, before: int | None = None) -> DataFrame:
    """Current ledger: for each day the version that the last commit points to."""
    return _days(spark, tables, Commits(spark, tables.commits).latest(before).days)


def _days(spark: SparkSession, tables: StateTables, days: dict[str, int]) -> DataFrame:
    schema = schemas.LEDGER + ", ledger_day STRING, batch_id LONG"
    if not days:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", tables.ledger).parquet(*[tables.day(d, v) for d, v in days.items()])


# --- seen ids ----------------------------------------------------------------------------------


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _version(tables: StateTables, version: int) -> str:
    return f"{tables.seen}/version={version}"


def seen_ids(spark: SparkSession, tables: StateTables, record: Record, buckets: list[int]) -> DataFrame:
    """Seen ids of some hash buckets, as of a record; only folders of these buckets are opened."""
    commits = Commits(spark, tables.commits)
    paths = [p for v in record.seen for b in buckets if commits.exists(p := f"{_version(tables, v)}/bucket={b}")]
    if not paths:
        return spark.createDataFrame([], _SEEN_IDS)
    return spark.read.schema(_SEEN_IDS).parquet(*paths)


def _write_seen(spark: SparkSession, tables: StateTables, before: Record, fresh: DataFrame, batch_id: int, horizon: int | None) -> tuple[int, ...]:
    """Write the ids of a batch as a new version, or all ids of the look-back as one; gives the versions that count."""
    versions = (*before.seen, batch_id)
    rows = fresh.select("id", "updated")
    if len(versions) > COMPACT:
        rows = rows.unionByName(seen_ids(spark, tables, before, list(range(BUCKETS)))).groupBy("id").agg(F.max("updated").alias("updated"))
        versions = (batch_id,)
    if horizon is not None:
        rows = rows.filter(F.unix_micros("updated") >= horizon)
    placed = rows.withColumn("bucket", bucket_of(F.col("id")))
    # One file per bucket, for one batch as for all.
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_version(tables, batch_id))
    return versions


# --- one batch ---------------------------------------------------------------------------------


def write_days(spark: SparkSession, tables: StateTables, records: DataFrame, batch_id: int, before: Record) -> tuple[dict[str, int], list[str]]:
    """Merge new records into the days they touch and write these days as a new version.

    Gives the pointers of all days and the folders that were read. Nothing is visible until a record has them.
    """
    fields = ["ledger_day", *[f"`{c}`" for c in rules.LEDGER_FIELDS]]
    fresh = records.select(*fields)
    touched = [_NO_DAY if r[0] is None else r[0] for r in fresh.select("ledger_day").distinct().collect()]
    old = {d: before.days[d] for d in touched if d in before.days}
    merged = merge_days(fresh, _days(spark, tables, old).select(*fields))
    path = f"{tables.ledger}/batch_id={batch_id}"
    merged.repartition("ledger_day").write.mode("overwrite").partitionBy("ledger_day").parquet(path)
    written = [n.removeprefix("ledger_day=") for n in Commits(spark, tables.commits).children(path) if n.startswith("ledger_day=")]
    return before.days | dict.fromkeys(written, batch_id), [tables.day(d, v) for d, v in old.items()]


def upsert_ledger(spark: SparkSession, tables: StateTables, records: DataFrame, batch_id: int) -> None:
    """Merge records into the ledger and commit: a batch of its own that touches nothing else."""
    commits = Commits(spark, tables.commits)
    if commits.read(batch_id) is None:
        before = commits.latest(batch_id)
        days, _ = write_days(spark, tables, records, batch_id, before)
        commits.write(replace(before, batch_id=batch_id, days=days, rows=0, late=0))


def merge_days(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """One record per day and normalised link pair, new before old."""
    rows = fresh.withColumn("__batch", F.lit(0)).unionByName(existing.withColumn("__batch", F.lit(1)))
    rows = rows.filter(not_blank(F.col("Paper Link")) & not_blank(F.col("Dataset Link")))
    keyed = rows.withColumns({"__p": norm_url(F.col("Paper Link")), "__d": norm_url(F.col("Dataset Link"))})
    order = [F.col("__batch"), F.col("Timestamp").desc(), F.col("Dataset Description")]
    return first_rows(keyed, ["ledger_day", "__p", "__d"], order).drop("__batch", "__p", "__d")


def process_batch(
    batch: DataFrame,
    batch_id: int,
    tables: StateTables,
    work: Callable[[DataFrame], DataFrame],
    cfg: FeedConfig = FeedConfig(),
    order: tuple = ("updated",),
) -> None:
    """One cycle: one owner per id, drop what succeeded before, work, write all sinks, commit them together.

    ``work`` adds status and the ledger fields, and may add the fields of a stage record. Rows of status "ok" are seen from
    then on; all others ("failed", "filtered") return with the look-back. The result of the work is written once and
    read back, so ledger and seen ids agree even if a task is repeated.

    With a look-back span, entries older than that span before the newest one are late: the source would not offer them
    any more, they are counted and left out. Without a span, ids are kept for good and only ``target_day`` is taken, if given.
    """
    spark = batch.sparkSession
    commits = Commits(spark, tables.commits)
    if commits.read(batch_id) is not None:
        return
    before = commits.latest(batch_id)
    offered = on_day(batch, cfg.target_day, "updated", cfg.look_back_days) if cfg.target_day else batch
    newest = offered.agg(F.unix_micros(F.max("updated"))).first()[0]
    newest = max((x for x in (before.newest, newest) if x is not None), default=None)
    horizon, late, live = None, 0, offered
    if cfg.look_back_days and newest is not None:
        horizon = newest - cfg.look_back_days * 86_400_000_000
        in_time = F.coalesce(F.unix_micros("updated") >= horizon, F.lit(False))
        live, late = offered.filter(in_time), offered.filter(~in_time).count()
    owned = one_owner(live, category_rank(F.col("category"), list(cfg.categories)), list(order))
    buckets = sorted(r[0] for r in owned.select(bucket_of(F.col("id"))).distinct().collect() if r[0] is not None)
    known = seen_ids(spark, tables, before, buckets)
    read = [f"{_version(tables, v)}/bucket={b}" for v in before.seen for b in buckets]

    staged = work(unseen(owned, known))
    have = set(staged.columns)
    fields = [F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], STAGED).schema]
    path = f"{tables.results}/batch_id={batch_id}"
    staged.select(*fields).write.mode("overwrite").parquet(path)
    rows = spark.read.schema(STAGED).parquet(path)
    done = rows.filter("status = 'ok'")

    versions = _write_seen(spark, tables, before, done, batch_id, horizon)
    if versions == (batch_id,):
        read = [_version(tables, v) for v in before.seen]
    days, opened = write_days(spark, tables, done.withColumn("ledger_day", ledger_day_of(F.col("updated"))), batch_id, before)
    marks = dict(before.progress)
    for r in done.filter("updated is not null").groupBy("category").agg(F.unix_micros(F.max("updated")).alias("t")).collect():
        marks[r["category"]] = max(r["t"], marks.get(r["category"], r["t"]))
    commits.write(Record(batch_id, newest, versions, days, marks, rows.count(), late, commits.size(*read, *opened)))


def vacuum(spark: SparkSession, tables: StateTables, keep: int = 2) -> list[str]:
    """Remove versions of seen ids and ledger days that none of the last ``keep`` records names; gives their folders."""
    commits = Commits(spark, tables.commits)
    last = commits.latest()
    records = [r for r in (commits.read(last.batch_id - k) for k in range(keep)) if r is not None]
    used = {_version(tables, v) for r in records for v in r.seen} | {tables.day(d, v) for r in records for d, v in r.days.items()}
    old = [f"{tables.seen}/{n}" for n in commits.children(tables.seen) if n.startswith("version=")]
    for n in commits.children(tables.ledger):
        old += [f"{tables.ledger}/{n}/{d}" for d in commits.children(f"{tables.ledger}/{n}") if d.startswith("ledger_day=")]

    def number(path: str) -> int:
        return int(path.split("version=" if "/version=" in path else "batch_id=")[1].split("/")[0])

    gone = [p for p in old if p not in used and number(p) <= last.batch_id]
    for p in gone:
        commits.remove(p)
    return gone


def ledger_day_of(updated: Column) -> Column:
    return F.date_format(updated, "yyyy-MM-dd")


# --- the loop ----------------------------------------------------------------------------------


def start(
    stream: DataFrame,
    tables: StateTables,
    work: Callable[[DataFrame], DataFrame],
    cfg: FeedConfig = FeedConfig(),
    order: tuple = ("updated",),
    available_now: bool = False,
) -> StreamingQuery:
    """Start the intake: every ``cfg.trigger``, or once over all that has landed."""

    def cycle(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, tables, work, cfg, order)

    trigger = {"availableNow": True} if available_now else {"processingTime": cfg.trigger}
    return (
        stream.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", tables.checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_until(query: StreamingQuery, should_stop: Callable[[], bool], poll_seconds: float = 1.0) -> None:
    """Wait for the query; stop it after the running batch once ``should_stop`` says so."""
    while query.isActive:
        if should_stop():
            while query.status["isTriggerActive"]:
                time.sleep(min(poll_seconds, 0.2))
            query.stop()
            return
        query.awaitTermination(poll_seconds)
