"""Pipeline stages over null and repeated ids: a row is known by its id and text."""

from test_llm_operators import prose

import corpus_pipeline

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], COLUMNS).repartition(4)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d, e, f = (prose(300 + k, 60) for k in range(6))
    near = a + " one more word"
    pairs = [
        (5, a), (None, a), (None, near), (None, b),  # a null copy of document 5, and a clean text without id
        (None, c), (None, c), (None, c + " tail"),  # a group of null ids only
        (7, d), (7, d), (7, e),  # one id three times, two of them equal
        (8, f), (9, f), (9, b + " " + e), (None, ""), (None, ""), (3, None),
    ]
    got = left(corpus_pipeline.near_duplicates(spark, table(spark, pairs), ""))
    one_c = [t for i, t in got if i is None and t and t.startswith(c)]
    assert len(one_c) == 1 and one_c[0] in (c, c + " tail")
    assert got == left(table(spark, [(5, a), (None, b), (None, one_c[0]), (7, d), (7, e), (8, f), (9, b + " " + e), (None, ""), (None, ""), (3, None)]))


def test_decontamination_takes_contaminated_rows_only(spark, tmp_path):
    item, a, b, c = prose(400, 20), prose(401, 60), prose(402, 60), prose(403, 60)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = [(None, a), (None, f"{b} {item}"), (7, c), (7, item), (7, c), (8, item), (None, None), (None, "")]
    got = left(corpus_pipeline.decontamination(spark, table(spark, pairs), str(tmp_path)))
    assert got == left(table(spark, [(None, a), (7, c), (7, c), (None, None), (None, "")]))
