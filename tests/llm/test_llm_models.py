"""Rule ensemble, whitening and periodic runs against brute force, exact values and held-out accuracy."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.llm import periodic_runs, rule_ensemble, whitening
from paperlode.llm.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(df):
    return brute.ordered(df.collect())


# --- periodic runs ---


def plain_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    w = brute.words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    told = brute.sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, told, brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (4, 3), (4, 2.5), (9, 2)])
def test_automaton_finds_every_run(least, times):
    rng = random.Random(least * 10 + int(times))
    for _ in range(600):
        n, letters = rng.randint(0, 50), "abcd"[:rng.randint(1, 4)]
        w = rng.choices(letters, k=n)
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        wanted = plain_runs(w, least, times)
        assert periodic_runs.runs_of(w, least, times) == wanted
        [row] = periodic_runs._rows([1], [" ".join(w).encode()], least, times)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == wanted


def test_runs_need_the_automaton(monkeypatch):
    """Without accesses to the link tree no run comes out."""
    words = list("xyxyxyxyxy")
    assert periodic_runs.runs_of(words) == [(0, 10, 2)]
    monkeypatch.setattr(periodic_runs.LinkTree, "access", lambda self, x, now: iter(()))
    assert periodic_runs.runs_of(words) == []


EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c " * 9), (6, "a a a a a a b a a a a a a"), (7, "é 日 é 日 " * 4),
    (-3, "x\x1cy x\x1cy " * 5), (8, " ".join(str(k % 700) for k in range(5000))), (9, "x " * 30_000), (10, "a a a a a b b b b b b"),
] + [(k, " ".join(random.Random(k).choices("pqrst", k=k % 90))) for k in range(20, 200)]


def test_periodic_runs(spark):
    df = spark.createDataFrame(EDGE, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("id", "runs", "words", "best", "h")})
    planted = df.withColumn("text", periodic_runs.with_planted_tail(F.col("doc_id"), F.col("text")))
    assert rows(periodic_runs.digests(periodic_runs.periodic_runs(planted))) == brute.ordered(plain_row(*r) for r in EDGE)
    assert periodic_runs.digests(periodic_runs.periodic_runs(df.filter("false"))).collect() == []
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(df).collect()}
    assert found[5]["collapsed"] == "a" and found[6]["collapsed"] == "a b a" and found[1]["n_words"] == 0
    with pytest.raises(ValueError, match="at least 2"):
        periodic_runs.periodic_runs(df, min_exponent=1)


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000")
    planted = docs.withColumn("text", periodic_runs.with_planted_tail(F.col("doc_id"), F.col("text")))
    got = rows(periodic_runs.digests(periodic_runs.periodic_runs(planted)))
    assert got == brute.ordered(plain_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > 10


# --- whitening ---


def numpy_whitening(x):
    """Covariance and its eigenvalues by numpy, of whole numbers."""
    z = x - x.mean(axis=0)
    v = z.T @ z / len(x)
    return v, np.linalg.eigvalsh(v)[::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigenvectors(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 2 * d))
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    close = q @ np.diag(np.sort(np.concatenate([np.full(d - d // 2, 5.0), 5 + 1e-13 * np.arange(d // 2)]))) @ q.T
    for v in (a @ a.T, np.eye(d) * 3, close, np.diag(np.arange(1.0, d + 1) ** 4), np.ones((d, d))):
        values, vectors = whitening.principal(v, d)
        wanted = np.linalg.eigvalsh(v)[::-1]
        k = len(values)
        assert k == (1 if v[0, 0] == 1 and d > 1 and v[0, -1] == 1 else d)
        assert np.abs(values - wanted[:k]).max() < 1e-12 * wanted[0]
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * wanted[0]
    assert len(whitening.principal(np.zeros((d, d)), 5)[0]) == 0


def test_sturm_counts():
    rng = np.random.default_rng(5)
    diagonal, off = rng.normal(size=30), rng.normal(size=29)
    full = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    at = np.linspace(-4, 4, 200)
    assert (whitening.below(diagonal, off, at, 1e-30) == [(np.linalg.eigvalsh(full) < x).sum() for x in at]).all()


def test_whitening_of_embeddings(spark):
    table = spark.read.parquet(f"{LARGER}/embeddings.parquet")
    got = QUERIES["op12_sturm_whitening"](spark, LARGER).toPandas()
    x = np.floor(64 * np.stack(table.orderBy("vec_id").toPandas()["embedding"]).astype(np.float64)) + 1_000_000
    v, values = numpy_whitening(x)
    n = len(x)
    assert len(got) == 32 * n and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    first = got[got["vec_id"] == 0].sort_values("component")
    assert np.allclose(first["explained"], values[:32] / np.trace(v), rtol=1e-9)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9
    vectors = np.linalg.eigh(v)[1][:, ::-1][:, :32]
    wanted = (x - x.mean(axis=0)) @ vectors / np.sqrt(values[:32])
    assert np.abs(np.abs(w) - np.abs(wanted)).max() < 1e-8
    whole = x.astype(int).tolist()
    sums = [sum(c) for c in zip(*whole, strict=True)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in whole]
    assert first["deviation"].iloc[0] == exact[0]
    assert got[got["component"] == 1].sort_values("vec_id")["deviation"].tolist() == exact
    spread = whitening.fit(whitening.whole_vectors(table.repartition(7), "vec_id", "embedding"))
    assert (spread.values == whitening.fit(whitening.whole_vectors(table, "vec_id", "embedding")).values).all()


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (8, [-inf, 0.0]), (9, [1.0]),
        (None, [0.5, -2.0]), (1, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("clash") for c in ("c", "x", "k", "place", "n")})
    got = whitening.whiten(df).toPandas()
    assert len(got) == 8 and (got["n"] == 4).all() and sorted(got["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 1, 1, 2, 2]
    assert got["identity_error"].max() < 1e-9 and abs(got[got["vec_id"] == 2]["explained"].sum() - 1) < 1e-12
    assert whitening.whiten(df.filter("false")).collect() == [] and whitening.whiten(df.filter("vec_id = 2")).collect() == []
    equal = df.filter("vec_id = 1")
    assert whitening.whiten(equal).collect() == []
    line = spark.createDataFrame([(k, [k / 7.0] * 40) for k in range(50)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(line).toPandas()
    assert len(got) == 50 and abs(got["explained"].max() - 1) < 1e-12 and got["identity_error"].max() < 1e-9
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(huge).toPandas()
    assert len(got) and got["deviation"].isna().any()
    wide = spark.createDataFrame([(k, [float(random.Random(31 * k + j).gauss(0, 1)) for j in range(90)]) for k in range(40)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(wide).toPandas()
    assert len(got) == 40 * 32 and got["identity_error"].max() < 1e-9


# --- rule ensemble ---


def test_tree_paths():
    text = "\n".join([
        "DecisionTreeClassificationModel: depth=2", "  If (feature 0 <= 0.5)", "   If (feature 1 <= 2.0)", "    Predict: 0.0", "   Else (feature 1 > 2.0)",
        "    Predict: 1.0", "  Else (feature 0 > 0.5)", "   If (feature 0 <= 0.9)", "    Predict: 1.0", "   Else (feature 0 > 0.9)", "    Predict: 0.0",
    ])
    assert rule_ensemble.path_rules(text, ["a", "b"]) == [
        (("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", "<=", 0.5), ("b", ">", 2.0)), (("a", ">", 0.5),),
        (("a", "<=", 0.9), ("a", ">", 0.5)), (("a", ">", 0.9),),
    ]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    stats = rule_ensemble.measured(docs.repartition(8))
    model = rule_ensemble.train(stats, labels)
    assert 5 < len(model.rules) < 120
    joined = rule_ensemble.scored(stats, model).join(labels, "doc_id").filter("held_out")
    right = {r["quality"]: r["a"] for r in joined.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).collect()}
    assert right[1] > 0.98 and right[0] > 0.95
    assert rule_ensemble.train(stats, labels) == model
    flipped = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.train(stats, flipped) == model  # held-out labels are not learned from
    assert rule_ensemble.train(stats, labels, max_rows=500) != model


def test_rules_are_compiled(spark):
    rules = (rule_ensemble.Rule((("lines", ">", 0.1),), 2.0), rule_ensemble.Rule((("lines", "<=", 0.5), ("stops", ">", 0.0)), -1.0))
    df = spark.createDataFrame([(0.0, 0.0), (0.2, 0.0), (0.2, 0.1), (0.9, 0.1)], "lines double, stops double")
    got = [r["s"] for r in df.select(rule_ensemble.Ensemble(rules, 0.5).score().alias("s")).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-t)) for t in (0.5, 2.5, 1.5, 2.5)])


def test_rule_ensemble_edges(spark):
    texts = [None, "", "  \n", "word", "Plain words go here. " * 40, "SHOUT!! " * 400, "é日本 " * 50, "x " * 60_000]
    data = [(k, t) for k, t in enumerate(texts)] + [(None, "a null id"), (4, texts[4])] + [(100 + k, f"Good text number {k} is here.") for k in range(60)] + [
        (200 + k, f"BAD!! TEXT!! {k} ### ###") for k in range(60)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("label", "words", "of", "place", "lines", "score")})
    labels = spark.createDataFrame(
        [(100 + k, 1) for k in range(60)] + [(200 + k, 0) for k in range(60)] + [(None, 1), (4, None), (5, 7)], "doc_id bigint, quality int"
    ).withColumns({c: F.lit("clash") for c in ("label", "of", "lines")})
    got = rule_ensemble.classify(df, labels).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[0] == score[1] and score[100] > 0.7 > score[200]
    assert {r["doc_id"]: r["held_out"] for r in got} == {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in data}
    assert rule_ensemble.classify(df.filter("false"), labels).collect() == []
    assert {r["score"] for r in rule_ensemble.classify(df, labels.filter("false")).collect()} == {0.5}
    some = rule_ensemble.classify(df, labels.filter("quality = 1")).first()["score"]
    assert 0.9 < some < 1
