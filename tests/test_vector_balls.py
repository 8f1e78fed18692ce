"""Vector search with bounds gives what the full scan gives, and leaves out what it may."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlode.operators import retrieval
from paperlode.operators.vector_balls import Balls, Profile, TopK, parts_of


def _full(q, ids, m, k):
    scores = np.round(q @ m.T, 9)
    out = []
    for line in scores:
        order = np.lexsort((ids, -line))[:k]
        out.append((list(ids[order]), list(line[order])))
    return out


def _clustered(rng, n, dim, clusters, width):
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(0, clusters, n)] + width * rng.normal(size=(n, dim))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 6), st.integers(1, 12), st.integers(1, 20))
def test_top_k_equals_full_scan(seed, n, dim, k, size):
    rng = np.random.default_rng(seed)
    # Whole numbers: many ties, repeated and zero vectors.
    m = rng.integers(-2, 3, size=(n, dim)).astype(float)
    q = rng.integers(-2, 3, size=(7, dim)).astype(float)
    ids = rng.permutation(n)
    found = TopK(q, k, size)
    for at in range(0, n, 50):
        found.add(ids[at:at + 50], m[at:at + 50])
    for i, (want_ids, want) in enumerate(_full(q, ids, m, k)):
        assert list(found.ids[i]) == want_ids and list(found.scores[i]) == want
    assert found.pairs == 7 * n and found.met <= found.pairs


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.sampled_from([-0.5, 0.0, 0.3, 0.99]))
def test_profile_equals_full_scan(seed, n, at_least):
    rng = np.random.default_rng(seed)
    m, q = _clustered(rng, n, 5, 4, 0.1), _clustered(rng, 6, 5, 4, 0.1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    found = Profile(q, at_least, 8)
    for at in range(0, n, 64):
        found.add(m[at:at + 64])
    scores = np.round(q @ m.T, 9)
    assert list(found.similar) == list((scores >= at_least).sum(axis=1))
    assert list(found.best) == list(scores.max(axis=1)) and set(found.compared) == {n}


def test_bounds_hold_and_parts_are_a_partition():
    rng = np.random.default_rng(1)
    m, q = _clustered(rng, 1000, 16, 9, 0.3), rng.normal(size=(20, 16))
    parts = parts_of(m, 50)
    assert sorted(np.concatenate(parts)) == list(range(1000)) and max(map(len, parts)) <= 50
    balls = Balls(q, m, 50)
    for j, part in enumerate(balls.parts):
        scores = q @ m[part].T
        assert (scores.max(axis=1) <= balls.upper[:, j]).all() and (scores.min(axis=1) >= balls.lower[:, j]).all()


def test_clusters_leave_out_most_pairs():
    rng = np.random.default_rng(2)
    m = _clustered(rng, 8000, 32, 40, 0.05)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = TopK(m[::80], 10)
    found.add(np.arange(8000), m)
    assert found.met < 0.2 * found.pairs
    assert [list(x) for x in found.ids] == [x for x, _ in _full(m[::80], np.arange(8000), m, 10)]


@pytest.mark.parametrize("inner", [False, True])
def test_in_spark_text_ids_bad_entries_and_empty_sides(spark, inner):
    rng = np.random.default_rng(3)
    m = _clustered(rng, 400, 6, 5, 0.2)
    m[5] = 0
    m[7, 2] = np.nan
    m[11] = m[12]
    rows = [(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)]
    c = spark.createDataFrame(rows, "cand_id string, vector array<double>").repartition(3)
    q = spark.createDataFrame([r for r in rows[:30] if r[0] != "c007"], "query_id string, vector array<double>")
    found = retrieval.cosine_top_k(q, c, 4, inner=inner)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Only the best k of every task travel.
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(query_id" in plan
    keep = np.array([i for i in range(400) if i != 7])
    unit = m if inner else m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    at = [i for i in range(30) if i != 7]
    want = {(f"c{i:03d}", r + 1, f"c{x:03d}") for i, (ids, _) in zip(at, _full(unit[at], keep, unit[keep], 4)) for r, x in enumerate(ids)}
    assert {(r.query_id, r["rank"], r.cand_id) for r in found.collect()} == want
    share = retrieval.met_share(q, c, 4, inner=inner).first()
    assert share.pairs == 29 * 400 and 0 < share.met < share.pairs
    assert retrieval.cosine_top_k(q.filter("false"), c, 4).count() == 0
    assert retrieval.cosine_top_k(q, c.filter("false"), 4).count() == 0
    assert retrieval.similarity_profile(q, c.filter("false"), 0.1).count() == 0


def test_profile_in_spark_equals_the_join(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(_clustered(rng, 300, 6, 5, 0.2))]
    c = spark.createDataFrame(rows, "cand_id long, vector array<double>").repartition(3)
    q = spark.createDataFrame(rows[:20], "query_id long, vector array<double>")
    held = retrieval.similarity_profile(q, c, 0.8).toPandas().sort_values("query_id", ignore_index=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "0")
    try:
        joined = retrieval.similarity_profile(q, c, 0.8).toPandas().sort_values("query_id", ignore_index=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pd.testing.assert_frame_equal(held, joined)


@pytest.mark.parametrize("inner", [False, True])
def test_many_queries_meet_all_candidates_without_a_copy_for_each_group(spark, inner):
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, size=(2500, 4)).astype(float)
    first = 2**60 + 1
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(m)]
    c = spark.createDataFrame(rows, "cand_id long, vector array<double>").repartition(3)
    q = c.withColumnRenamed("cand_id", "query_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "0")
    try:
        found = retrieval.cosine_top_k(q, c, 4, inner=inner)
        got = {(r.query_id - first, r["rank"], r.cand_id - first) for r in found.collect()}
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        # No more copies than the grid of the session's tasks has sides, however many queries there are.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = retrieval._cells(q, c, "query_id", "cand_id", "vector", 2500 * 4 * 8)
        assert cells.count() <= 2500 * 2 * (tasks ** 0.5 + 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    unit = m if inner else m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    ids = np.arange(2500)
    assert got == {(i, r + 1, int(x)) for i, (best, _) in enumerate(_full(unit, ids, unit, 4)) for r, x in enumerate(best)}


def test_slices_of_queries_equal_full_scan(monkeypatch):
    monkeypatch.setattr("paperlode.operators.vector_balls.SLICE", 7)
    rng = np.random.default_rng(6)
    m = rng.integers(-2, 3, size=(300, 3)).astype(float)
    found, profile = TopK(m[:50], 5, 16), Profile(m[:50], 1.0, 16)
    for at in range(0, 300, 64):
        found.add(np.arange(300)[at:at + 64], m[at:at + 64])
        profile.add(m[at:at + 64])
    assert [(list(a), list(b)) for a, b in zip(found.ids, found.scores)] == _full(m[:50], np.arange(300), m, 5)
    scores = m[:50] @ m.T
    assert list(profile.similar) == list((scores >= 1.0).sum(axis=1)) and list(profile.best) == list(scores.max(axis=1))


def _same(q, m, k, size=16, step=100):
    ids = np.random.default_rng(9).permutation(len(m))
    found = TopK(q, k, size)
    for at in range(0, len(m), step):
        found.add(ids[at:at + step], m[at:at + step])
    want = _full(q, ids, m, k)
    assert [list(x) for x in found.ids] == [x for x, _ in want]
    return found


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e18, 1e-20])
def test_single_precision_decides_nothing(scale):
    rng = np.random.default_rng(7)
    # Vectors that differ by less than single precision holds: the order is that of double precision.
    one = rng.normal(size=24)
    m = np.concatenate([one + 3e-9 * rng.normal(size=(400, 24)), rng.normal(size=(200, 24))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q = np.concatenate([m[:150], m[-40:]])
    _same(scale * q, m / scale, 10)
    _same(q, m, 10)


def test_equal_vectors_and_queries_without_a_number():
    m = np.ones((500, 4))
    q = np.concatenate([m[:30], np.full((1, 4), np.nan), np.zeros((2, 4))])
    ids = np.random.default_rng(8).permutation(500)
    found = TopK(q, 6, 16)
    for at in range(0, 500, 100):
        found.add(ids[at:at + 100], m[at:at + 100])
    assert [list(x) for n, x in enumerate(found.ids) if n != 30] == [list(range(6))] * 32 and found.ids[30] is None


def test_a_merge_serves_many_parts(monkeypatch):
    rng = np.random.default_rng(10)
    m = rng.normal(size=(4000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    merge, calls = TopK._merge, []

    def counted(self, *args):
        calls.append(1)
        return merge(self, *args)

    monkeypatch.setattr(TopK, "_merge", counted)
    # No part of independent vectors can be left out; sorting after each of them took more time than the products.
    found = _same(m[:300], m, 10, 32, 4000)
    assert found.met > 0.9 * found.pairs and len(calls) < len(parts_of(m, 32)) / 3
