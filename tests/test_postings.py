"""The gram index against a search through all records."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlode.operators import postings, quality, retrieval

TEXTS = [
    "The cat sat on the mat", "Naïve Bayes über Größe", "日本語 の 文書", "a b c", "", None, "theatre THE the", "x" * 70_000 + " end",
    "İstanbul straße", "tab\tand wide blank", "cat\ncatalogue", "同じ 日本",
]


@given(st.sets(st.integers(-2**62, 2**62), min_size=1, max_size=40))
def test_keys_survive_packing(keys):
    ordered = np.array(sorted(keys), dtype=np.int64)
    assert postings.unpacked_keys(*postings.packed_keys(ordered)).tolist() == ordered.tolist()


@given(st.text(min_size=1, max_size=12), st.text(max_size=6), st.text(max_size=6))
def test_grams_of_a_part_are_in_the_index(part, before, after):
    assert postings.search_grams(part) <= postings.index_grams({before + part + after})


def test_search_agrees_with_a_scan(spark, tmp_path):
    rows = [(k * 10**9 - 3, t, "https://x.org/" + str(k)) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id bigint, `Dataset Description` string, `Dataset Link` string")
    records = df.withColumn("Paper Link", F.lit("p")).withColumn("Timestamp", F.col("id").cast("string")).withColumn("__key", F.lit(1))
    records = records.drop("__key").withColumn("term", F.lit("clash")).withColumn("bucket", F.lit(0))
    path = str(tmp_path / "index")
    postings.write_postings(records, path, "id", bucket_records=5)
    for query in ("the cat", "日本", "größe X", "a", "i", "straße none", "absentword", "org/11 THE the", "", None, "xxxx"):
        for limit in (50, 2):
            got = postings.search_postings(records, path, query, "id", limit, tie=["id"]).select("id", *["score"] * bool((query or "").split())).collect()
            want = retrieval.keyword_search(records, query, limit, tie=["id"]).select("id", *["score"] * bool((query or "").split())).collect()
            assert got == want, query
    assert {r["key"] for r in postings.matching_keys(spark, path, ["cat"]).collect()} == {rows[0][0], rows[10][0]}


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, a string, Timestamp string")
    postings.write_postings(none, str(tmp_path / "i"), "id", ["a"])
    assert postings.search_postings(none, str(tmp_path / "i"), "word", "id", fields=["a"], tie=["id"]).collect() == []


def test_rows_by_paper(spark):
    rows = [("p", n, n % 2, 1) for n in range(25)] + [("q", 0, 1, 1), (None, 0, 0, 1)]
    df = spark.createDataFrame(rows, "paper_name string, n int, predicted_label int, true_label int")
    got = {(r["paper_name"], r["part"]): r for r in quality.rows_by_paper(df, "n", ["predicted_label"], part_rows=10).collect()}
    assert [x["n"] for x in got["p", 1]["rows"]] == list(range(10, 20)) and len(got["p", 2]["rows"]) == 5
    assert (got["p", 0]["correct"], got["p", 2]["total"]) == (12, 25) and got[None, 0]["accuracy"] == 0.0 and len(got) == 5
