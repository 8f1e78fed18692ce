"""Splittable arrays of JSON records against Spark's own reader of whole files."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlode.sources import json_arrays
from paperlode.sources.json_arrays import json_records, json_texts

SCHEMA = "id LONG, text STRING, inner STRUCT<a: ARRAY<STRUCT<b: STRING>>, c: STRING>"
_ODD = ['plain', '}', '{', '"}', '\\', '\\"}', '[{"id":1}]', '}}}', 'é日\n\t', '"data": [', '', '","id":7},{"id":9', '\\\\}"']


def _records(n, seed):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choices(_ODD, k=rng.randint(0, 6)))

    return [{"id": k, "text": text() * rng.choice([1, 1, 1, 40]), "inner": {"a": [{"b": text()} for _ in range(rng.randint(0, 3))], "c": text()}} for k in range(n)]


@pytest.fixture
def small_splits(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(c, size) for c in before]
    for c, v in before.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("size", ["250", "3000", "128m"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_any_split(spark, tmp_path, small_splits, size, wrapped):
    n = 12 if size == "250" else 150
    for f in range(3):
        rows = _records(n if f else 3, f)
        value = {"meta": [{"id": -1}], "info": {"data": 3, "more": [{"id": -2}]}, "data": rows, "after": [{"id": -3}]} if wrapped else rows
        (tmp_path / f"{f}.json").write_text(json.dumps(value, indent=None if f == 1 else 2, ensure_ascii=f == 2), encoding="utf-8")
    small_splits(size)
    got = json_records(spark, str(tmp_path), SCHEMA, numbered=True)
    ours = sorted((r["file"][-6:], r["place"], json.dumps(r["r"].asDict(True))) for r in got.select("file", "place", F.struct("id", "text", "inner").alias("r")).collect())
    assert [o[1] for o in ours] == [k for f in range(3) for k in range(n if f else 3)]
    theirs = [(f"{f}.json", json.dumps(r)) for f in range(3) for r in _records(n if f else 3, f)]
    assert [(o[0], o[2]) for o in ours] == theirs


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = _records(20_000, 5)
    (tmp_path / "large.json").write_text(json.dumps(rows))
    small_splits("200k")
    texts = json_texts(spark, str(tmp_path))
    assert texts.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 10
    schema = "id LONG, text STRING"
    mine = json_records(spark, str(tmp_path), schema).select("id", "text")
    whole = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    assert mine.count() == 20_000 and mine.exceptAll(whole).count() == 0 and whole.exceptAll(mine).count() == 0


def test_odd_files(spark, tmp_path, small_splits):
    files = {
        "empty": "", "none": "[]", "blank": " \n", "one": '[{"id": 1}]', "numbers": '[1, "x", null, {"id": 2}, [3, {"id": 4}]]', "cut": '[{"id": 5}, {"id": 6}, {"id',
        "cut_string": '[{"id": 7}, {"text": "never closed}', "wrapped_none": '{"data": []}', "other": '{"rows": [{"id": 8}]}', "bom": '\ufeff[{"id": 9}]', "tail": '[{"id": 10}]\n\n',
        "nested": '{"data": [{"id": 11, "data": [{"id": 12}]}]}', "cut_data": '{"data": [{"id": 13}, {"id": 14',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    for size in ("16", "128m"):
        small_splits(size)
        got = {}
        for r in json_records(spark, str(tmp_path), "id LONG").collect():
            got.setdefault(r["file"].split("/")[-1][:-5], []).append(r["id"])
        assert got == {"one": [1], "numbers": [2], "cut": [5, 6], "cut_string": [7], "bom": [9], "tail": [10], "nested": [11], "cut_data": [13]}
        whole = {r["file"].split("/")[-1][:-5] for r in json_records(spark, str(tmp_path), "id LONG", whole_files=True).collect()}
        assert whole == {"one", "numbers", "bom", "tail", "nested"}


def test_files_are_scanned_three_times_to_number_records_and_first_splits_in_one_state(spark, tmp_path, monkeypatch):
    """One pass finds the states, one the borders and the counts, one the records; a file begins outside a string."""
    passes = []
    held = json_arrays.staged

    def count(df, name):
        passes.append((name, df))
        return held(df, name)

    monkeypatch.setattr(json_arrays, "staged", count)
    (tmp_path / "a.json").write_text('[{"a": "}x"}, {"a": "y"}]')
    texts = json_arrays.json_texts(spark, str(tmp_path), numbered=True)
    assert [(r.place, r.text) for r in texts.orderBy("place").collect()] == [(0, '{"a": "}x"}'), (1, '{"a": "y"}')]
    scans = {name: df._jdf.queryExecution().executedPlan().toString().count("FileScan text") for name, df in passes}
    assert scans == {"splits": 1, "borders": 1, "offsets": 0}
    changes = list(json_arrays._changes([pa.RecordBatch.from_pydict({"f": ["a", "a"], "b": [0, 9], "v": ['[{"a": 1', " "]})]))
    assert [len(b.column("quoted")[0].as_py()) for b in changes] == [1, 2]
