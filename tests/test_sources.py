"""Readers on landed files of the original layouts."""

import io
import json
import tarfile

import numpy as np
from pyspark.sql import functions as F

from paperlode import schemas
from paperlode.plans import retrieval as experiments
from paperlode.hooks import HashingEncoder
from paperlode.sources import archives, json_files, markup, sinks


def test_papers_by_day_and_category(spark, tmp_path):
    folder = tmp_path / "2025-10-15（7）"
    folder.mkdir()
    (folder / "cs.AI.json").write_text(json.dumps([{"id": "1", "title": "t"}, {"id": "2"}], indent=2))
    rows = json_files.read_papers(spark, str(tmp_path)).select("id", "title", "day", "category").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "t", "2025-10-15（7）", "cs.AI"), ("2", None, "2025-10-15（7）", "cs.AI")]


def test_training_shards_of_both_shapes(spark, tmp_path):
    (tmp_path / "a_train_dataset.json").write_text(json.dumps([{"title": "t", "abstract": "a", "label": 1}], indent=1))
    (tmp_path / "b_train_dataset.json").write_text(json.dumps({"data": [{"text": "x", "has_dataset": 0}, {"text": "y", "has_dataset": 1}]}))
    rows = json_files.read_training_shards(spark, str(tmp_path / "*_train_dataset.json")).orderBy("file", "pos").collect()
    assert [(r.title, r.text, r.label, r.has_dataset) for r in rows] == [("t", None, 1, None), (None, "x", None, 0), (None, "y", None, 1)]


def test_ledger_skips_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Paper Link": "p", "Dataset Link": "d", "Timestamp": "1"}]))
    (tmp_path / "b.json").write_text("[{broken")
    rows = json_files.read_ledger(spark, str(tmp_path))
    assert [r["Paper Link"] for r in json_files.result_index(rows, ["file"]).collect()] == ["p"]


def test_partial_files(spark, tmp_path):
    folder = tmp_path / "day" / "cat"
    folder.mkdir(parents=True)
    (folder / "2401.00001v1.partial.json").write_text(json.dumps({"abstract": "See https://osf.io/1.", "published": " 2024 "}))
    (folder / "other.partial.json").write_text("{}")
    rows = json_files.partial_entries(json_files.read_whole(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in rows] == [("https://arxiv.org/pdf/2401.00001v1.pdf", "https://osf.io/1", "See https://osf.io/1.", "2024")]


def test_queries(spark, tmp_path):
    (tmp_path / "query.json").write_text(json.dumps([{"query": "q", "positives": ["a", "b"], "ground_truth": {"paper_link": "p"}, "meta": None}]))
    row = json_files.read_queries(spark, str(tmp_path / "query.json")).first()
    assert json.loads(row.positives) == ["a", "b"] and json.loads(row.ground_truth) == {"paper_link": "p"}


def test_feed(spark, tmp_path):
    feed = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
    <entry><id>http://arxiv.org/abs/2401.00001v2</id><title> A &amp; B </title><summary>s</summary><updated>u</updated><published>p</published></entry>
    <entry><id></id><title>x</title><link href="http://h/a" type="text/html"/><link href="http://h/b.pdf"/></entry></feed>"""
    (tmp_path / "f.xml").write_text(feed)
    rows = markup.read_feed(spark, str(tmp_path)).drop("file").orderBy("title").collect()
    assert tuple(rows[0]) == ("2401.00001v2", "A & B", "s", "u", "p", "https://arxiv.org/pdf/2401.00001v2.pdf")
    assert rows[1].pdf_link == "http://h/b.pdf"


def test_tei():
    tei = "<TEI xmlns='u'><div><head>H</head><p>a<ref>1</ref> lost</p><div><p> b </p></div></div><div><p/></div></TEI>"
    assert markup.read_tei(tei) == [{"section": "H", "full_text": "a b"}, {"section": "", "full_text": "b"}]
    assert markup.read_tei("<TEI><x> some\n text</x></TEI>") == [{"section": "", "full_text": "some text"}]
    assert markup.read_tei("<broken") is None


def test_archives(spark, tmp_path):
    def tar(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for path, data in members.items():
                info = tarfile.TarInfo(path)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    tar("p1.tar.gz", {"b.tex": b"B", "a/z.bib": b"Z", "../evil.tex": b"E", "x.png": b"P"})
    tar("p2.tar.gz", {"big.tex": bytes(range(256)) * 400})
    small = archives.read_archives(spark, str(tmp_path), limit=300)
    rows = archives.expand_archives(small).orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("p1", "a/z.bib", "Z"), ("p1", "b.tex", "B")]
    joined = archives.concatenate_sources(archives.expand_archives(small)).first()["text"]
    assert joined == "\n\n===== b.tex =====\nB\n\n===== a/z.bib =====\nZ"


def test_archives_that_cannot_be_read_are_listed(spark, tmp_path):
    def tar(name, members, mode="w:gz"):
        with tarfile.open(tmp_path / name, mode) as t:
            for path, data in members.items():
                info = tarfile.TarInfo(path)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    rng = np.random.default_rng(0)
    tar("good.tar.gz", {"b.tex": "é".encode(), "x.png": b"P", "/etc/a.tex": b"E"})
    tar("plain.tar", {"c.tex": b"C"}, "w")
    tar("none.tgz", {"x.png": b"P"})
    tar("cut.tar.gz", {"a.tex": b"first", "b.tex": rng.bytes(9000)})
    whole = (tmp_path / "cut.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[:5000])  # the first member is whole, the second is not
    (tmp_path / "noise.tar.gz").write_bytes(b"noise")
    (tmp_path / "empty.tar.gz").write_bytes(b"")
    tar("big.tar.gz", {"a.tex": rng.bytes(40000)})
    members, rejects = archives.read_members(spark, str(tmp_path), limit=20000)
    assert sorted(tuple(r) for r in members.collect()) == [("good", "b.tex", "é"), ("plain", "c.tex", "C")]
    found = sorted((r.paper_id, r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect())
    # Spark's file listing has no row for a file without bytes, so there is nothing to reject.
    assert spark.read.format("binaryFile").load(str(tmp_path / "empty.tar.gz")).count() == 0
    assert found == [
        ("big", "big.tar.gz", "too large"), ("cut", "cut.tar.gz", "broken"), ("noise", "noise.tar.gz", "broken")
    ]


def test_long_archives_are_handed_on_in_slices():
    members = [("a", "x" * 6), ("b", "y" * 6), ("c", "z"), ("d", "")]
    assert [[n for n, _ in part] for part in archives.slices(iter(members), 10)] == [["a", "b"], ["c", "d"]]
    assert list(archives.slices(iter([]))) == []


def test_metadata_write_is_by_partition(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("1", "d1", "c"), ("2", "d2", "c")], "id string, day string, category string")
    sinks.write_metadata(df, path)
    sinks.write_metadata(df.filter("day = 'd1'").withColumn("id", F.lit("9")), path)
    assert sorted((r.id, r.day) for r in sinks.read_metadata(spark, path, "id STRING").collect()) == [("2", "d2"), ("9", "d1")]
    sinks.write_metadata(df.filter("false"), path, [("d1", "c"), ("d3", "c")])
    assert [(r.id, r.day) for r in sinks.read_metadata(spark, path, "id STRING").collect()] == [("2", "d2")]


def test_experiment(spark, tmp_path):
    q = spark.createDataFrame([("q1", "red cats", ""), ("q2", "blue dogs", "")], "query_id string, query string, instruction string")
    c = spark.createDataFrame([("c1", "blue dogs bark"), ("c2", "red cats sleep"), ("c3", "green fish")], "cand_id string, body string")
    links = c.select("cand_id", F.col("cand_id").alias("link"))
    truth = spark.createDataFrame([("q1", "c2"), ("q2", "c1")], "query_id string, link string")
    done = experiments.run_experiment(q, c, links, truth, HashingEncoder(512), str(tmp_path), ks=(1, 2))
    assert done["name"] == "hashing-512_without_instruction"
    saved = sinks.read_experiment(spark, str(tmp_path), "score", "metric STRING, k INT, mean DOUBLE").filter("metric = 'hit_rate' and k = 1").first()
    assert saved["mean"] == 1.0


def test_schemas_parse(spark):
    for name in ("PAPER", "CORPUS_FILE", "LEDGER", "PARTIAL", "QUERY", "GATE_SAMPLE"):
        assert spark.createDataFrame([], getattr(schemas, name)).schema.fields


def test_members_of_many_archives_share_slices():
    members = [(0, "a", "xxxx"), (1, "b", "yyyyyy"), (1, "c", "z")]
    assert [[m[:2] for m in part] for part in archives.slices(iter(members), 10)] == [[(0, "a"), (1, "b")], [(1, "c")]]


def test_sections_of_a_large_batch_are_made_in_slices():
    import pandas as pd

    documents = pd.Series([f"<TEI><div><p>{i}</p></div></TEI>" for i in range(600)] + [None, "<TEI"])
    made = list(markup.read_slices(iter([documents, documents.iloc[:3], documents.iloc[:0]])))
    assert [len(x) for x in made] == [256, 256, 90, 3]
    rows = pd.concat(made).to_list()
    assert rows[599] == [{"section": "", "full_text": "599"}] and rows[600:602] == [None, None] and rows[602] == rows[0]
