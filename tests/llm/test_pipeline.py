"""The pipeline's stages against brute force over each stage's own input."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        ids = sorted(r["doc_id"] for r in docs.collect())
        if name == "quality rules":
            assert ids == sorted(r[0] for r in brute.quality(before) if r[-1])
        elif name == "near-dedup":
            assert ids == sorted(r[0] for r in brute.near([x[:2] for x in before]) if r[-1])
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in brute.contaminated([x[:2] for x in before], items) if not r[-1])
        elif name == "mixing":
            sizes = {}
            for _, t, s in before:
                sizes[s] = sizes.get(s, 0) + len(brute.words(t))
            got = {}
            for r in docs.collect():
                got[r["source"]] = got.get(r["source"], 0) + len(brute.words(r["text"]))
            assert all(abs(got.get(s, 0) - t) <= 1 for s, t in brute.shares(sizes).items())
        else:
            assert ids == sorted(x[0] for x in before)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
        seen.append(len(ids))
    assert seen[0] > seen[1] > 0 and corpus_pipeline.ORACLE_SQL is None
