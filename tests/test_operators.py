"""Operators against sequential brute force on small data, with hot keys."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.config import LinkConfig, PackConfig, WindowConfig
from paperlode.functions.text import LABEL_REQUEST, count_tokens, split_sentences
from paperlode.operators import ledger, links, quality, ranks, retrieval, sentences, splits, windows


def _pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- ranks -------------------------------------------------------------------------------------


def test_row_numbers_with_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", p) for i, p in enumerate(rng.sample(range(100000), 3000))]
    df = spark.createDataFrame(rows, "key string, pos long")
    got = ranks.row_numbers(df, ["key"], {"b": ranks.position_block(F.col("pos"), 500)}, [F.col("pos")], "rn")
    expected = []
    for k in {k for k, _ in rows}:
        expected += [(k, p, i) for i, p in enumerate(sorted(p for kk, p in rows if kk == k))]
    assert _pairs(got, "key", "pos", "rn") == sorted(expected)


def test_row_numbers_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "key string, pos long")
    got = ranks.row_numbers(df, ["key"], {"b": ranks.position_block(F.col("pos"), 1)}, [F.col("pos")], "rn")
    assert sorted(((r.key or "", r.pos, r.rn) for r in got.collect())) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_last_seen(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.choice([None, None, f"s{p}"])) for k in ("a", "b") for p in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "key string, pos long, v string")
    got = ranks.last_seen(df, ["key"], {"b": ranks.position_block(F.col("pos"), 50)}, ["pos"], "v", "found")
    expected = []
    for k in ("a", "b"):
        last = None
        for _, p, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = v or last
            expected.append((k, p, last or ""))
    assert sorted((r.key, r.pos, r.found or "") for r in got.collect()) == sorted(expected)


def test_limits_run_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("key", F.col("id") % 3)
    plan = ranks.first_rows(df, ["key"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("WindowGroupLimit [key", plan.index("Exchange"))


# --- chains ------------------------------------------------------------------------------------


def test_a_chain_makes_tables_only_of_chunks_that_lead_to_another(spark):
    """Papers of one chunk are walked once; one paper of many chunks beside them makes no table of theirs."""
    calls = spark.sparkContext.accumulator(0)

    def steps(columns, own):
        calls.add(1)
        return np.full(own, 2)

    def emit(columns, stops):
        return {"at": columns["gid"][stops]}

    d = spark.range(60).select(F.col("id").alias("paper_name"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") == 7, 99).otherwise(4))).alias("gid"))
    found = windows.chain(d, "paper_name", "gid", 3, steps, emit, "at LONG", 10).collect()
    assert sorted((r.paper_name, r["at"]) for r in found) == [(p, i) for p in range(60) for i in range(0, 100 if p == 7 else 5, 2)]
    # Ten chunks of the long paper, nine of them with a table; each of the others once.
    assert calls.value <= 59 + 10 + 9


def _extents(tokens, cfg):
    """Sentences from each position that fit: the largest count below the budget, in closed form, and the minimum at least."""
    total = np.concatenate([[0], np.cumsum(np.array(tokens) + 1)])  # a separator goes with each sentence
    room = np.searchsorted(total, total[:-1] + cfg.max_tokens - 3, side="left") - 1 - np.arange(len(tokens))
    return np.minimum(np.maximum(room, cfg.min_sentences), len(tokens) - np.arange(len(tokens)))


def _check_windows(got, tokens, labels, cfg, training):
    """Properties of the windows (start, first, last, tokens, positive) of one paper, and of the steps between them."""
    extent, n = _extents(tokens, cfg), len(tokens)
    positives = {k for k, y in enumerate(labels) if y == 1} if training else set()
    by_start = {w[0]: w for w in got}
    assert len(by_start) == len(got)
    start = 0
    while start < n:
        reach = range(start, start + int(extent[start]))
        first_hit = min(positives & set(reach), default=None)
        window = by_start.pop(start, None)
        shown = [m for m in reach if first_hit is None or abs(m - first_hit) <= cfg.context]
        if len(shown) < cfg.min_sentences:
            assert window is None
        else:
            assert window[1:] == (shown[0], shown[-1], sum(tokens[m] for m in shown), first_hit is not None)
        # A full window of the minimum or more steps by a share of its planned length.
        planned = max(cfg.min_sentences, len(reach))
        start += max(1, planned // (2 if first_hit is None else cfg.positive_step_div))
    assert not by_start


@pytest.mark.parametrize("training", [False, True])
@pytest.mark.parametrize("cfg", [
    WindowConfig(max_tokens=20, chunk=25),  # many chunks per paper
    WindowConfig(max_tokens=60, min_sentences=7, context=6, chunk=70),
    WindowConfig(),
])
def test_token_windows(spark, cfg, training):
    rng = random.Random(3)
    papers = {"long": 900, "short": 2, "middle": 40, "one": 1, "edge": 50}
    data = {p: ([rng.choice([0, 1, 3, 5, 30]) for _ in range(n)], [int(rng.random() < 0.05) for _ in range(n)]) for p, n in papers.items()}
    rows = [(p, i, t, y) for p, (ts, ys) in data.items() for i, (t, y) in enumerate(zip(ts, ys))]
    df = spark.createDataFrame(rows, "paper_name string, gid long, tokens int, label int")
    got = _pairs(windows.token_windows(df, cfg, training), "paper_name", "window_id", "first", "last", "window_tokens", "has_positive")
    for p, (ts, ys) in data.items():
        _check_windows([g[1:] for g in got if g[0] == p], ts, ys, cfg, training)


def test_token_windows_on_many_levels(spark, monkeypatch):
    """A fan of 2 makes the scan over the chunks several levels deep."""
    monkeypatch.setattr(windows, "_FAN", 2)
    cfg = WindowConfig(max_tokens=16, chunk=17)
    rng = random.Random(4)
    tokens = [rng.choice([1, 2, 4]) for _ in range(400)]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(tokens)], "paper_name string, gid long, tokens int")
    got = _pairs(windows.token_windows(df, cfg), "window_id", "first", "last", "window_tokens", "has_positive")
    _check_windows(got, tokens, [0] * 400, cfg, False)


def test_window_size_fixture(spark):
    df = spark.createDataFrame([("p", i, 5) for i in range(6)], "paper_name string, gid long, tokens int")
    got = _pairs(windows.token_windows(df, WindowConfig(max_tokens=20)), "first", "last")
    assert got == [(0, 2), (1, 3), (2, 4), (3, 5)]


@pytest.mark.parametrize("cfg", [PackConfig(budget=600, max_items=10, chunk=11), PackConfig(budget=2000)])
def test_character_packing(spark, cfg):
    rng = random.Random(5)
    data = {p: [rng.choice([3, 50, 120, 700]) for _ in range(n)] for p, n in {"a": 300, "bb": 5, "c": 130}.items()}
    rows = [(p, i, c) for p, cs in data.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "paper_name string, gid long, n_chars int")

    def prompt(title, chars, start):
        head = LABEL_REQUEST.format(title=title, first=start + 1, last=start + len(chars))
        return head + "\n".join(f"句子{start + i + 1}: " + "x" * (c if c <= cfg.cut else cfg.cut + 3) for i, c in enumerate(chars))

    expected = []
    for p, cs in data.items():
        i = 0
        while i < len(cs):
            j = i
            while j < len(cs) and j - i < cfg.max_items and len(prompt(p, cs[i:j + 1], i)) <= cfg.budget:
                j += 1
            expected.append((p, i, max(j, i + 1) - 1, cfg.cut if j > i else max(200, cfg.budget // 8)))
            i = max(j, i + 1)
    assert _pairs(windows.pack_by_characters(df, cfg), "paper_name", "first", "last", "cut") == sorted(expected)


def test_pivot_span_is_within_the_budget_and_maximal():
    rng = random.Random(6)
    for _ in range(2000):
        n = rng.randint(1, 12)
        tokens = [rng.randint(1, 9) for _ in range(n)]
        pivot, budget, least, context = rng.randrange(n), rng.randint(3, 40), rng.randint(1, 7), rng.randint(0, 2)
        start, stop = windows.pivot_span(tokens, pivot, budget, least, context)
        core = (max(0, pivot - context), min(n, pivot + context + 1))
        used = sum(tokens[start:stop]) + (stop - start - 1)
        assert start <= core[0] and core[1] <= stop
        assert (start, stop) == core or used <= budget
        assert start == 0 or used + tokens[start - 1] + 1 > budget
        assert stop == n or used + tokens[stop] + 1 > budget


@pytest.mark.parametrize("pivot, budget, least, context, span", [
    (4, 9, 1, 0, (2, 7)), (4, 7, 1, 0, (2, 6)), (0, 5, 3, 1, (0, 3)), (8, 5, 3, 0, (6, 9)), (4, 1, 3, 0, (4, 5)), (4, 1, 3, 2, (2, 7)), (4, 99, 1, 0, (0, 9)),
])
def test_pivot_span_grows_left_first(pivot, budget, least, context, span):
    """Nine sentences of one token; separators count one each."""
    assert windows.pivot_span([1] * 9, pivot, budget, least, context) == span


def test_votes(spark):
    probs = spark.createDataFrame([("p", 0, 0.4, 0), ("p", 0, 0.8, 1)], "paper_name string, gid long, prob double, label int")
    rows = spark.createDataFrame([("p", 0), ("p", 1)], "paper_name string, gid long")
    assert _pairs(windows.mean_vote(probs, rows), "gid", "prob", "label") == [(0, 0.6, 1), (1, 0.0, 0)]
    assert _pairs(windows.any_vote(probs), "gid", "label") == [(0, 1)]


# --- sentences ---------------------------------------------------------------------------------


def test_neighbour_context_at_block_edges(spark):
    n = 4096 * 2 + 5
    df = spark.range(n).select(F.lit("p").alias("k"), F.col("id").alias("gid"), F.col("id").cast("string").alias("text"))
    got = {r.gid: (r.ctx_before, r.ctx_after) for r in sentences.neighbour_context(df, ["k"], "gid").filter("gid % 4096 < 3 or gid % 4096 > 4093").collect()}
    for g, (before, after) in got.items():
        assert before == [str(x) for x in range(max(0, g - 2), g)]
        assert after == [str(x) for x in range(g + 1, min(n, g + 3))]


def test_description(spark):
    rows = spark.createDataFrame([("p", 0, "a ", 1), ("p", 1, "b", 0), ("p", 2, " c", 1), ("q", 0, "x", 0)], "paper_name string, gid long, text string, label int")
    got = sentences.collect_description(rows, ["paper_name"], ["gid"])
    assert _pairs(got, "paper_name", "description") == [("p", "a c"), ("q", "")]
    cut = sentences.collect_description(rows, ["paper_name"], ["gid"], max_chars=2)
    assert _pairs(cut, "paper_name", "description") == [("p", "a ..."), ("q", "")]


def test_description_cap_at_every_length(spark):
    texts = ["ab", " cde ", "", "f", "ghij k"]
    rows = spark.createDataFrame([("p", i * 3000, t, 1) for i, t in enumerate(texts)], "paper_name string, gid long, text string, label int")
    whole = " ".join(t.strip() for t in texts if t.strip())
    for cap in range(1, len(whole) + 2):
        got = sentences.collect_description(rows, ["paper_name"], ["gid"], max_chars=cap).first()["description"]
        assert got == (whole[:cap].rstrip() + " ..." if len(whole) > cap else whole), cap


def test_description_of_first_section(spark):
    rows = spark.createDataFrame(
        [("p", "a", 1, 0, "x", 1), ("p", "a", 1, 1, "y", 0), ("p", "a", 2, 2, "z", 1), ("p", "b", 1, 3, "w", 1)],
        "paper_name string, section string, paragraph_id int, gid long, text string, label int",
    )
    got = sentences.collect_description(rows, ["paper_name"], ["gid"], first_section_only=True)
    assert _pairs(got, "paper_name", "description") == [("p", "x")]


def test_fan_out(spark):
    df = spark.createDataFrame([("p", ["b", "a", "b", ""]), ("q", [])], "id string, links array<string>")
    assert _pairs(links.fan_out_links(df), "id", "link") == [("p", "a"), ("p", "b"), ("q", "")]
    assert _pairs(links.fan_out_links(df, keep_empty=False), "id", "link") == [("p", "a"), ("p", "b")]


def test_sections_and_positions(spark):
    links_df = spark.createDataFrame([("f", 5, "a"), ("f", 25, "b"), ("f", 40, "c")], "file string, pos long, url string")
    heads = spark.createDataFrame([("f", 10, "One"), ("f", 40, "Two")], "file string, pos long, section string")
    assert _pairs(sentences.section_asof(links_df, heads, ["file"]), "url", "section") == [("a", ""), ("b", "One"), ("c", "Two")]
    spans = spark.createDataFrame([("f", 0, 0, 8), ("f", 1, 10, 20), ("f", 2, 21, 30)], "file string, sid long, span_start long, span_end long")
    points = spark.createDataFrame([("f", p) for p in (0, 8, 9, 10, 19, 20, 29, 30, 99)], "file string, pos long")
    got = _pairs(sentences.sentence_at(points, spans, ["file"]), "pos", "sentence_index")
    assert got == [(0, 0), (8, 0), (9, 0), (10, 1), (19, 1), (20, 0), (29, 2), (30, 2), (99, 2)]


# --- links -------------------------------------------------------------------------------------


def test_extract_links(spark):
    tex = (
        "\\section{Intro}\nFirst one. Second one. See \\href{https://a.org/x%20y}{our data} here. Third one. Fourth.\n"
        "\\subsection*{Data}\nGet \\url{https://b.org/1.} now. The end, https://c.org/z."
    )
    df = spark.createDataFrame([("p", "main.tex", tex)], "paper_id string, path string, text string")
    rows = links.extract_links(df).orderBy("form", "pos").collect()
    got = [(r.form, r.url, r.anchor, r.line, r.section) for r in rows]
    assert got[:2] == [(0, "https://a.org/x y", "our data", 2, "Intro"), (1, "https://b.org/1", "", 4, "Data")]
    assert [g[1] for g in got[2:]] == ["https://a.org/x y", "https://b.org/1", "https://c.org/z"]
    assert rows[0].ctx_before == ["\\section{Intro}\nFirst one.", "Second one."]
    assert rows[0].ctx_after == ["Third one.", "Fourth."]


def test_extract_links_against_search(spark):
    """Positions, lines, sections and neighbours against a plain scan of each text."""
    import re

    rng = random.Random(7)
    words = ["Data. ", "we use it ", "\\section{S%d} ", "\\url{http://u/%d} ", "\\href{http://h/%d}{a} ", "see http://b/%d! ", "\n", "好。 "]
    texts = ["".join(w % i if "%d" in w else w for i, w in enumerate(rng.choices(words, k=60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "paper_id int, text string")
    sents = {r.paper_id: r.s for r in df.select("paper_id", split_sentences(F.col("text")).alias("s")).collect()}
    for r in links.extract_links(df).collect():
        t, s = texts[r.paper_id], sents[r.paper_id]
        assert r.line == t[:r.pos].count("\n") + 1
        heads = [m.group(1) for m in re.finditer(r"\\section\{([^}]*)\}", t) if m.start() <= r.pos]
        assert r.section == (heads[-1] if heads else "")
        at, spans = 0, []
        for x in s:
            start = t.find(x, at)
            spans.append((start, start + len(x)))
            at = start + len(x)
        inside = [i for i, (a, b) in enumerate(spans) if a <= r.pos < b]
        i = inside[0] if inside else (len(s) - 1 if r.pos >= spans[-1][1] else 0)
        assert r.ctx_before == s[max(0, i - 2):i] and r.ctx_after == s[i + 1:i + 3]


def _cands(spark, *rows):
    df = spark.createDataFrame([("p", i, u, "", s) for i, (u, s) in enumerate(rows)], "paper_id string, pos int, url string, anchor string, score int")
    return links.with_url_keys(df)


def _rule(spark, *rows):
    top = links.leading_candidates(_cands(spark, *rows))
    pick = top.select(links.rule_pick(F.col("top")).alias("p")).first()["p"]
    return pick and pick["url"]


def test_rule_pick(spark):
    assert _rule(spark, ("https://x.org/a", -4)) == "https://x.org/a"
    assert _rule(spark, ("https://x.org/a", 22), ("https://x.org/b", 21)) == "https://x.org/a"
    assert _rule(spark, ("https://x.org/a", 16), ("https://x.org/b", 11)) == "https://x.org/a"
    hf = "https://huggingface.co/datasets/o/n"
    assert _rule(spark, ("https://x.org/a", 16), (hf, 12)) is None
    assert _rule(spark, ("https://x.org/a", 16), (hf, 15)) == hf


def test_resolver_modes(spark):
    cands = _cands(spark, ("https://x.org/a", 3), ("https://x.org/b", 4))
    ext = spark.createDataFrame([("p", "https://x.org/a", "said", 0.9)], "paper_id string, url string, why string, confidence double")

    def run(cfg, external=None):
        return [(r.picked_by, r.url) for r in links.resolve_primary(cands, external, cfg).collect()]

    assert run(LinkConfig(mode="rule")) == [("fallback-top1", "https://x.org/b")]
    assert run(LinkConfig(mode="rule", fallback_top1=False)) == []
    assert run(LinkConfig(), ext) == [("llm", "https://x.org/a")]
    preferred = _cands(spark, ("https://x.org/a", 30), ("https://osf.io/1", 7))
    assert [r.url for r in links.resolve_primary(preferred, ext, LinkConfig()).collect()] == ["https://osf.io/1"]


# --- ledger ------------------------------------------------------------------------------------

LEDGER = "`Paper Link` string, `Dataset Link` string, `Dataset Description` string, Timestamp string, pos int"


def test_dedupe_prefers_new_and_is_stable(spark):
    old = spark.createDataFrame([("http://p", "https://d.org", "x", "old", 0), ("http://p", "", "x", "old", 1)], LEDGER)
    new = spark.createDataFrame([("http://p", "https://D.org/", "y", "new", 0)], LEDGER)
    once = ledger.dedupe_records(new, old, ["pos"])
    assert _pairs(once, "Timestamp") == [("new",)]
    assert _pairs(ledger.dedupe_records(once, once, ["pos"]), "Timestamp") == [("new",)]


def test_merge_fill_rules(spark):
    link = "https://arxiv.org/pdf/2401.{}.pdf"
    old = spark.createDataFrame(
        [(link.format("1v1"), "", "d", "t", 0), (link.format("1v1"), "ignored", "", "", 1), (link.format("7"), "keep", "", "", 2)], LEDGER
    )
    new = spark.createDataFrame(
        [(link.format("1v1"), "", "", "", 0), (link.format("1v1"), "L1", "", "", 1), (link.format("1v1"), "L2", "", "", 2), (link.format("9"), "gone", "", "", 3)], LEDGER
    )
    got = _pairs(ledger.merge_fill(old, new), "Paper Link", "Dataset Link", "Dataset Description")
    assert got == [(link.format("1v1"), "L1", "d"), (link.format("7"), "keep", "")]
    assert ledger.unkeyed_count(new).first()["unkeyed"] == 1


def test_merge_outer_form(spark):
    a = spark.createDataFrame([("k1", "x", ""), ("k2", " ", "b")], "id string, f string, g string")
    b = spark.createDataFrame([("k1", "y", "z"), ("k2", "w", "v"), ("k3", None, "n")], "id string, f string, g string")
    got = _pairs(ledger.merge_fill_outer(a, b, "id", ["f", "g"]), "id", "f", "g")
    assert got == [("k1", "x", "z"), ("k2", "w", "b"), ("k3", "", "n")]


# --- retrieval ---------------------------------------------------------------------------------


def test_metrics_fixture(spark):
    ranked = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "y")], "query_id string, rank int, link string")
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("none", "a")], "query_id string, link string")
    rows = {r.query_id: r for r in retrieval.ranking_metrics(ranked, truth, [3]).collect()}
    got = rows["q"]
    assert (got.hit_rate, got.mrr, got.recall) == (1.0, 0.5, 0.5)
    assert round(got.precision, 6) == 0.333333 and round(got.f1, 6) == 0.4
    assert round(got.ndcg, 6) == 0.386853 and got.average_precision == 0.25
    assert rows["none"].hit_rate == 0.0 and rows["none"].ndcg == 0.0


def test_repeated_links_count_unless_distinct(spark):
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a")], "query_id string, rank int, link string")
    truth = spark.createDataFrame([("q", "a")], "query_id string, link string")
    assert retrieval.ranking_metrics(ranked, truth, [2]).first().recall == 2.0
    assert retrieval.ranking_metrics(ranked, truth, [2], distinct_links=True).first().recall == 1.0


@pytest.mark.parametrize("limit", ["10485760", "0"])  # broadcast and salted join
def test_cosine_top_k(spark, limit):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 8))
    vectors[7] = 0
    vectors[9] = vectors[11]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    c = spark.createDataFrame(rows, "cand_id long, vector array<float>")
    q = spark.createDataFrame(rows[:50], "query_id long, vector array<float>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = _pairs(retrieval.cosine_top_k(q, c, 5, size=64), "query_id", "rank", "cand_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    v = vectors.astype(np.float32).astype(np.float64)
    length = np.linalg.norm(v, axis=1)
    unit = v / np.where(length == 0, 1, length)[:, None]
    scores = np.round(unit[:50] @ unit.T, 9)
    expected = []
    for i, line in enumerate(scores):
        order = np.lexsort((np.arange(300), -line))[:5]
        expected += [(i, r + 1, int(x)) for r, x in enumerate(order)]
    assert got == sorted(expected)


def test_search_text_nested(spark):
    df = spark.createDataFrame([("t", ["x", "y"], ("n", None), None)], "b string, a array<string>, c struct<k: string, j: string>, d string")
    assert retrieval.search_text(df).first()["search_text"] == "a: x y b: t c: k: n"


def test_keyword_search(spark):
    df = spark.createDataFrame([("p1", "d", "data data", "1"), ("p2", "data", "x", "2"), ("p3", "y", "z", "3")], "`Paper Link` string, `Dataset Link` string, `Dataset Description` string, Timestamp string")
    got = [(r["Paper Link"], r["score"]) for r in retrieval.keyword_search(df, " DATA ").collect()]
    assert got == [("p1", 2), ("p2", 1)]
    assert [r["Paper Link"] for r in retrieval.keyword_search(df, "", 2).collect()] == ["p3", "p2"]


# --- splits ------------------------------------------------------------------------------------


def _greedy(sizes, k):
    loads, out = [0] * k, {}
    for p, s in sorted(enumerate(sizes), key=lambda x: -x[1]):
        i = min(range(k), key=lambda j: loads[j])
        out[p], loads[i] = i, loads[i] + s
    return out


@pytest.mark.parametrize("sizes,k", [([5, 4, 3, 3], 2), ([0, 0, 3, 0, 1], 3), ([random.Random(9).choice([0, 1, 1, 2, 7, 50]) for _ in range(500)], 4)])
def test_balanced_shards(spark, sizes, k):
    df = spark.createDataFrame([(str(i), i, s) for i, s in enumerate(sizes)], "paper string, first_pos long, size long")
    got = {int(r.paper): r.shard for r in splits.balanced_shards(df, k).collect()}
    assert got == _greedy(sizes, k)


def test_equal_shards(spark):
    df = spark.createDataFrame([(f"p{i}", i * 10) for i in range(5)], "paper string, first_pos long")
    assert _pairs(splits.equal_shards(df, 2), "paper", "shard") == [("p0", 0), ("p1", 0), ("p2", 0), ("p3", 1), ("p4", 1)]


def test_blank_papers_stand_alone(spark):
    df = spark.createDataFrame([("a", 0), (" ", 1), (None, 2), ("a", 3)], "paper_name string, pos long")
    assert splits.first_seen_papers(df).count() == 3


def test_adjust_by_sentences(spark):
    rows = [(f"p{i}", "train", 10 + i) for i in range(20)] + [("t", "test", 3)]
    df = spark.createDataFrame(rows, "paper string, split string, size long")
    got = splits.adjust_by_sentences(df)
    target = round(sum(r[2] for r in rows) / 12)
    size = got.filter("split = 'test'").agg(F.sum("size")).first()[0]
    assert abs(size - target) < abs(3 - target)
    assert got.count() == len(rows)


def test_lossless(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    splits.assert_lossless(a, a, ["v"])
    with pytest.raises(AssertionError):
        splits.assert_lossless(a, a.distinct(), ["v"])


def test_training_text_needs_text_and_label(spark):
    good = spark.createDataFrame([("t", "a", None, 1)], "title string, abstract string, text string, label int")
    assert quality.training_text(good).first()["text"] == "t [SEP] a"
    bad = spark.createDataFrame([("t", None, None, 1)], "title string, abstract string, text string, label int")
    with pytest.raises(Exception, match="sample without text"):
        quality.training_text(bad).collect()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0.7, 1, 1), (0.7, 1, 1), (float("nan"), 0, 1)], "confidence double, predicted_label int, true_label int")
    got = _pairs(quality.confidence_histogram(df).filter("subset = 'correct'"), "bin", "n")
    assert got == [(10, 2)]


def test_links_are_matched_once_per_file(spark):
    files = spark.createDataFrame([("p", r"\section{A} One. \href{https://a.org/x}{b}. Two.")], "paper_id string, text string")
    found = links.extract_links(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert [r["url"] for r in found.filter("form = 0").collect()] == ["https://a.org/x"]


def test_mean_vote_reads_short_papers_as_one_window(spark):
    from paperlode.hooks import window_scorer
    from paperlode.plans.curation import label_sentences

    one = [{"sentence_id": 0, "text": "A dataset.", "label": 0}]
    rows = [("p", "s", 0, one), ("q", "s", 0, [one[0], {"sentence_id": 1, "text": "No.", "label": 0}]), ("r", "s", 0, one * 5)]
    items = spark.createDataFrame(rows, "paper_name string, section string, paragraph_id int, sentences array<struct<sentence_id:int,text:string,label:int>>")
    scorer = window_scorer(lambda ws: [[(len(w) * 10 + k) / 100 for k in range(len(w))] for w in ws])
    got = _pairs(label_sentences(items, scorer, vote="mean", whole_windows=True), "paper_name", "gid", "prob")
    assert got[:3] == [("p", 0, 0.1), ("q", 0, 0.2), ("q", 1, 0.21)] and all(p > 0 for _, _, p in got[3:])


def test_pivot_window_leaves_out_blank_neighbours(spark):
    df = spark.createDataFrame([(["a", " ", "b"], ["", "c"])], "before array<string>, after array<string>")
    tokens = F.transform(F.concat("before", F.array(F.lit("P")), "after"), lambda t: F.lit(1))
    window = windows.pivot_window(F.col("before"), F.col("after"), F.lit("P"), tokens, max_tokens=100)
    assert df.select(window.alias("w")).first()["w"] == ["a", "b", "P", "c"]


def test_pivot_window_counts_the_tokens_of_a_sentence_once(spark):
    """A text of 15000 sentences; with the counts of all sentences taken anew for each one it runs for minutes."""
    n = 15000
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word "), i.cast("string"))).alias("s"))
    d = d.select(F.slice("s", 1, n // 2).alias("before"), F.slice("s", n // 2 + 1, n).alias("after"))
    tokens = F.transform(F.concat("before", F.array(F.lit("P")), "after"), count_tokens)
    began = time.monotonic()
    got = d.select(windows.pivot_window(F.col("before"), F.col("after"), F.lit("P"), tokens, max_tokens=100).alias("w")).first()["w"]
    assert time.monotonic() - began < 30 and "P" in got and len(got) == 33 and got[0] == f"word {int(got[-1].split()[1]) - 31}"
