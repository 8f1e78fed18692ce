"""The operators against brute force: driver tables, and rows with nulls, repeats, long texts and clashing columns."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from paperlode.llm import (
    chat, decontaminate, line_align, line_quality, mixing, near_dedup, suffix_dedup, token_store, url_filter, window_dedup,
)
from paperlode.llm.components import components

SF = "/root/testdata/sf0.001"
_RNG = random.Random(5)
_VOCABULARY = ["".join(_RNG.choices("abcdefgé", k=_RNG.randint(2, 7))) for _ in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choices(_VOCABULARY, k=n))


LONG = prose(1, 300)
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", "a"), (5, "Short text here", "b"), (6, LONG, "b"), (7, LONG, "b"),
    (8, LONG[:900] + " tail " + prose(2, 30), None), (None, LONG, "c"), (9, "x " * 3000, "c"), (9, "x " * 3000, "c"), (10, prose(3, 4000) + " " + LONG, "a"),
    (11, "é\u2003日本 " * 40 + "\x1c|#*", "a"), (12, LONG.upper(), "c"), (13, prose(4, 80) + "\n" + prose(4, 80), "b"), (14, "short TEXT here", "b"),
]
CLASHING = ["block", "node", "bucket", "id", "h", "start", "k", "shard", "ids", "label", "turn", "host", "lines"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame(EDGE, "doc_id bigint, text string, source string")
    return rows.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return brute.ordered(df.collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000}])
def test_word_windows(edge, nothing, options):
    assert rows(window_dedup.digests(window_dedup.dedup(edge, **options))) == brute.windows([(d, t) for d, t, _ in EDGE])
    assert rows(window_dedup.dedup(nothing)) == []


def test_word_windows_keep_every_repeat_of_any_shape(spark):
    """Periodic texts, windows at both ends, one window in two documents."""
    shared = prose(9, 35)
    docs = [(1, "a b " * 60), (2, shared), (3, prose(10, 50) + " " + shared), (4, shared + " " + prose(11, 50)), (5, prose(12, 34) + " " + prose(12, 34))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for block_bytes in (1, 200, 1 << 20):
        assert rows(window_dedup.digests(window_dedup.dedup(df, block_bytes=block_bytes))) == brute.windows(docs)


def test_sketches_are_merged_by_adding_counts():
    """Estimates are never below the true count of all blocks, and seldom above it."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 900, 700).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
    width, slices = 8 * 2800, 16
    sketches = [window_dedup.Sketch(b, np.arange(len(b)), width, slices) for b in blocks]
    sent = pd.DataFrame([row for k, s in enumerate(sketches) for row in s.send(k)])
    answers = pd.concat([window_dedup.merge(rows) for _, rows in sent.groupby("bucket")])
    every, counts = np.unique(np.concatenate(blocks), return_counts=True)
    true = dict(zip(every.tolist(), counts.tolist(), strict=True))
    over = []
    for k, (b, s) in enumerate(zip(blocks, sketches, strict=True)):
        got = s.estimates(answers[answers["block"] == k][["bucket", "seen"]].to_dict("records"))
        over += [int(e) - true[key] for key, e in zip(b.tolist(), got.tolist(), strict=True)]
    assert min(over) == 0 and max(counts) > 4
    assert sum(x > 0 for x in over) < 0.03 * len(over)
    hot = [window_dedup.Sketch(np.full(200, 7, dtype=np.uint64), np.arange(200), width, slices) for _ in range(2)]
    sent = pd.DataFrame([row for k, s in enumerate(hot) for row in s.send(k)])
    answers = pd.concat([window_dedup.merge(rows) for _, rows in sent.groupby("bucket")])
    got = hot[0].estimates(answers[answers["block"] == 0][["bucket", "seen"]].to_dict("records"))
    assert set(got.tolist()) == {window_dedup.SATURATED}


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000}])
def test_byte_substrings(edge, nothing, options):
    assert rows(suffix_dedup.digests(suffix_dedup.dedup(edge, **options))) == brute.substrings([(d, t) for d, t, _ in EDGE])
    assert rows(suffix_dedup.dedup(nothing)) == []


def test_byte_substrings_at_every_offset(spark):
    """Repeats of exactly 400 bytes and one less, at offsets that meet all residues of the cover."""
    part = prose(20, 200).encode()[:400].decode("utf-8", "ignore")
    part = (part + "zz")[:400] if len(part.encode()) < 400 else part
    docs = [(0, part)] + [(k, prose(100 + k, 40)[:k] + part) for k in range(1, 60)] + [(99, "q" + part.encode()[:399].decode("utf-8", "ignore"))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(suffix_dedup.digests(suffix_dedup.dedup(df, block_bytes=5000))) == brute.substrings(docs)


def test_cover_has_every_difference():
    found = {(a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert found == set(range(suffix_dedup.MODULUS))


def test_byte_substrings_of_documents(documents):
    some = documents.filter("length(text) < 3000")
    assert rows(suffix_dedup.digests(suffix_dedup.dedup(some))) == brute.substrings(pairs(some))


def test_near_duplicates(edge, nothing):
    assert rows(near_dedup.digests(near_dedup.near_duplicates(edge))) == brute.near([(d, t) for d, t, _ in EDGE])
    assert rows(near_dedup.near_duplicates(nothing)) == []


@pytest.mark.parametrize("options", [{}, {"small": 2, "chunk": 7}])
def test_near_duplicates_in_a_large_group(spark, options):
    """Copies with edits around the limit of similarity: links that no star shows must be found as well."""
    rng = random.Random(3)
    base = prose(50, 120).split()
    docs = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 40)}"
        docs.append((k, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(near_dedup.digests(near_dedup.near_duplicates(df, **options))) == brute.near(docs)


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    every = rng.integers(1, 2**63, 4000, dtype=np.uint64)
    for n in (1, 2, 7, 60, 1000):
        assert near_dedup.sketch(every[:n]).max() != near_dedup._EMPTY
    same = np.mean([np.mean(near_dedup.sketch(every[k:k + 100]) == near_dedup.sketch(every[k + 20:k + 120])) for k in range(0, 3000, 100)])
    assert abs(same - 80 / 120) < 0.03


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 105), (105, 101), (200, 201)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 105: 100, 200: 200, 201: 200}


ITEMS = [
    (1, LONG[200:700]), (2, None), (None, "short text HERE"), (3, ""), (3, prose(4, 20)), (4, "One"), (5, prose(77, 13)), (5, LONG[200:700]), (6, "日本"),
]


@pytest.mark.parametrize("group_bytes", [1 << 20, 300])
def test_decontamination(spark, edge, nothing, group_bytes):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("group", F.lit("clash"))
    found = decontaminate.find_items(edge, items, group_bytes=group_bytes)
    assert rows(decontaminate.digests(found)) == brute.contaminated([(d, t) for d, t, _ in EDGE], ITEMS)
    assert rows(decontaminate.find_items(nothing, items)) == []
    none = decontaminate.digests(decontaminate.find_items(edge, items.filter("false")))
    assert rows(none) == brute.contaminated([(d, t) for d, t, _ in EDGE], [])


def test_line_quality(spark, edge, nothing, documents):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows(line_quality.assess(edge.drop("host", "lines")).select(*columns)) == brute.quality(EDGE)
    assert rows(line_quality.assess(nothing).select(*columns)) == []
    menu = "Home  |  About | CONTACT us now"
    docs = [(k, f"{prose(k, 40)}\n{menu if k % 3 else menu.lower()}\n{prose(1000 + k, 20)}", "s") for k in range(30)]
    docs += [(100 + k, f"{menu}\n{menu}\n{menu}\n{prose(k, 14)}", "s") for k in range(3)] + [(200, docs[0][1], "t"), (201, prose(8, 30) + " " + prose(8, 30), "t")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_chars", F.lit(0))
    judged = line_quality.assess(df)
    assert rows(judged.select(*columns)) == brute.quality(docs)
    left = {r["doc_id"]: r["text"] for r in line_quality.apply(df, judged).collect()}
    assert set(left) == {r[0] for r in brute.quality(docs) if r[7]}
    assert left[1] == f"{prose(1, 40)}\n{prose(1001, 20)}" and left[200] == docs[0][1]


def test_line_rule_acts(spark):
    """On the larger tables the limit of 20 documents takes lines off, rejects few documents, and is the same for a large host."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    judged = line_quality.assess(docs).cache()
    cut = judged.filter("removed_lines > 0")
    assert cut.count() > 500 and judged.agg(F.sum("removed_lines")).first()[0] >= cut.count()
    depleted = judged.filter("not base_failed and not kept")
    assert 0 < depleted.count() < 0.01 * judged.count()
    whole = line_quality.apply(docs, judged)
    assert whole.count() == judged.filter("kept").count()
    host = docs.withColumn("source", F.lit("one"))
    assert line_quality.assess(host).agg(F.sum("removed_lines")).first()[0] > judged.agg(F.sum("removed_lines")).first()[0]


HIDDEN = ["__id", "__hash", "__cut", "__key", "__text_hash", "__words", "__size", "__row", "__number", "__nth", "__stays", "__mark", "__host", "__kept"]


def test_apply_with_columns_of_any_name(spark, edge):
    """No column of the caller clashes with one that an operator uses."""
    plain = edge.select("doc_id", "text", "source")
    odd = plain.withColumns({c: F.lit("mine") for c in [*HIDDEN, "c0", "a b", "x.y"]})
    items = spark.createDataFrame([(1, prose(4, 20))], "item_id bigint, text string")

    def results(df):
        return [
            line_quality.apply(df, line_quality.assess(df)), near_dedup.apply(df, near_dedup.near_duplicates(df)),
            decontaminate.apply(df, decontaminate.find_items(df, items)), mixing.apply(df, *mixing.mix(df)), line_align.apply(df, line_align.align(df)),
        ]

    for got, wanted in zip(results(odd), results(plain), strict=True):
        assert got.columns == odd.columns and {r["__id"] for r in got.collect()} <= {"mine"}
        assert rows(got.select("doc_id", "text", "source")) == rows(wanted)


def test_near_duplicates_without_ids(spark):
    """Null ids, or one id for all rows, give the same groups as ids of their own."""
    rng = random.Random(8)
    texts = [prose(700 + k % 40, 60) + (" tail" if rng.random() < 0.5 else "") for k in range(120)]

    def groups(ids):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
        found = near_dedup.near_duplicates(df).select("text_hash", "label").distinct().collect()
        by = {}
        for r in found:
            by.setdefault(r["label"], set()).add(r["text_hash"])
        return sorted(map(sorted, by.values()))

    assert groups(range(120)) == groups([None] * 120) == groups([7] * 120)


def sizes_of(docs):
    out = {}
    for _, t, s in docs:
        out[s] = out.get(s, 0) + len(brute.words(t))
    return out


@pytest.mark.parametrize("options", [{}, {"block_words": 50, "shard_blocks": 2}])
def test_mix(spark, edge, nothing, options):
    documents, pieces = mixing.mix(edge, **options)
    got = mixing.taken_words(documents, pieces).collect()
    again = mixing.taken_words(*mixing.mix(edge.repartition(5), **options)).collect()
    assert brute.ordered(got) == brute.ordered(again)
    sizes, target = sizes_of(EDGE), brute.shares(sizes_of(EDGE))
    assert sorted(r["size"] for r in got) == sorted(len(brute.words(t)) for _, t, _ in EDGE)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[round(r["target"], 6)] = taken.get(round(r["target"], 6), 0) + r["taken"]
    assert {round(t, 6) for t in target.values()} == set(taken)
    assert all(abs(t - n) <= 1 for t, n in taken.items())
    # Every block is drawn once, by one shard, and blocks are whole.
    drawn = pieces.groupBy("k", "epoch", "block").agg(F.countDistinct("shard").alias("s"), F.sum("words").alias("w")).collect()
    assert all(r["s"] == 1 for r in drawn)
    loads = [r["count"] for r in pieces.select("shard", "k", "epoch", "block").distinct().groupBy("shard").count().collect()]
    assert max(loads) - min(loads) <= 3
    mixed = mixing.apply(edge, documents, pieces)
    assert mixed.columns == edge.columns
    assert sum(len(brute.words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.taken_words(*mixing.mix(nothing)).collect() == []
    assert mixing.shards(nothing, *mixing.mix(nothing)).collect() == []
    assert sum(sizes.values()) > 0


def _blocks_by_shard(pieces):
    """Blocks of each source by shard, and the place of every piece."""
    drawn = pieces.select("shard", "k", "epoch", "block").distinct().groupBy("k").count().collect()
    where = {(r["k"], r["start"], r["epoch"], r["block"]): (r["shard"], r["place"]) for r in pieces.collect()}
    return {r["k"]: r["count"] for r in drawn}, where


def test_shards_hold_the_mix(spark, edge):
    """Texts of shards are the words the mix takes, in the order of places; another seed deals other shards of equal quotas."""
    options = {"block_words": 50, "shard_blocks": 2}
    documents, pieces = mixing.mix(edge, **options)
    got = [r for part in mixing.shards(edge, documents, pieces).rdd.glom().collect() for r in part]
    assert [(r["shard"], r["place"]) for r in got] == sorted((r["shard"], r["place"]) for r in got)
    assert all(len(brute.words(r["text"])) == r["words"] for r in got)
    taken = mixing.taken_words(documents, pieces).collect()
    assert sum(r["words"] for r in got) == sum(r["taken"] for r in taken)
    # The first epoch of a text that is taken whole, put together again.
    whole = next(t for d, t, _ in EDGE if d == 13)
    row = next(r for r in taken if r["doc_id"] == 13)
    parts = sorted((p["first"], p["shard"], p["place"]) for p in pieces.filter("doc_id = 13 AND epoch = 0").collect())
    texts = {(r["shard"], r["place"]): r["text"] for r in got}
    if row["taken"] >= row["size"]:
        assert brute.words(" ".join(texts[p[1:]] for p in parts)) == brute.words(whole)
    assert all(texts[p[1:]] in whole for p in parts)  # white space between words stays
    first = min((p["shard"], p["place"]) for p in pieces.filter("doc_id = 13").collect())
    assert (row["first_shard"], row["first_place"]) == first
    quotas, where = _blocks_by_shard(pieces)
    other_quotas, other = _blocks_by_shard(mixing.mix(edge, seed=2, **options)[1])
    assert quotas == other_quotas and where != other
    assert len({s for s, _ in where.values()}) >= mixing.MIN_SHARDS


def test_split_is_hypergeometric(spark):
    """Over many seeds, the left half's share of a source has the mean and variance of the distribution."""
    import statistics

    root = spark.createDataFrame([([30, 50, 20],)], "q array<bigint>")
    got = []
    for seed in range(60):
        leaves = {r["shard"]: r["q"] for r in mixing.split_quotas(root, 1, seed).collect()}
        assert [a + b for a, b in zip(leaves[0], leaves[1], strict=True)] == [30, 50, 20] and sum(leaves[0]) == 50
        got.append(leaves[0][0])
    assert abs(statistics.mean(got) - 15) < 1.5
    assert 2 < statistics.pvariance(got) < 11  # 50 * 0.3 * 0.7 * 50 / 99 = 5.3


def test_targets(spark):
    rng = random.Random(7)
    for n in (1, 2, 3, 10):
        sizes = {f"s{k}": rng.choice([0, 5, 100, 10_000]) for k in range(n)} | {None: 7}
        df = spark.createDataFrame([(s, z) for s, z in sizes.items()], "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute.shares(sizes), abs=1e-6)


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://www.example.com/fr/", "http://x.net/es/1",
        "http://x.net/es", "http://net/fr/", "http://example.org/a?b", "http://xnet/es/1", "http://a.com?x", "http://com/", "x://h#/en/", "http://b://c/d",
    ]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    model = url_filter.train(url_filter.labelled_words(spark))
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    rules = {4: ("example.com/en/", "block"), 5: ("www.example.com/en/", "allow"), 6: ("com/", "allow"), 7: ("net/es/", "block"), 9: ("net/fr/", "block"), 13: ("com/", "allow")}
    assert {k: (r["rule"], r["verdict"]) for k, r in got.items() if r["rule"]} == rules
    assert (got[4]["host"], got[4]["path"]) == ("a.example.com", "/en/x")
    assert (got[12]["host"], got[12]["path"]) == ("a.com", "") and (got[14]["host"], got[14]["path"]) == ("h", "")
    assert (got[15]["host"], got[15]["path"]) == ("b:", "//c/d")
    assert all((got[k]["host"], got[k]["path"]) == ("", "") for k in (0, 1, 2, 3))
    assert url_filter.judge(pages.filter("false"), model).collect() == []
    assert url_filter.train(url_filter.labelled_words(spark).filter("label = 1")) is None
    # Hosts the model has not seen: words of the lists in other company, and invented ones.
    junk = [f"http://{a}-{b}.example.org/en/5" for a, b in zip(url_filter.JUNK[:20], url_filter.JUNK[20:40], strict=True)]
    clean = [f"http://{a}{b}.example.org/en/5" for a, b in zip(url_filter.CLEAN[:20], url_filter.CLEAN[40:60], strict=True)]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(junk + clean)], "page_id bigint, url string")
    verdicts = [r["verdict"] for r in url_filter.judge(table, model).orderBy("page_id").collect()]
    assert verdicts[:20].count("block") >= 18 and verdicts[20:].count("allow") >= 18


TURNS = [
    (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "x\\h<>\\\\h### b:\n</turn>\n"), (None, 0, None, "t"), (2, None, "us:er\n#", "\\"),
    (2, 0, "assistant", ":\n\\l"), (2, 0, "assistant", ":\n\\l"), (3, 5, "assistant", "y" * 50_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    turns = chat.canonical_turns(df.withColumn("piece", F.lit("clash")), columns=["conv_id", "turn", "role", "text"])
    back = chat.read_back(chat.format_turns(turns))
    plain = [(c, r or "", t or "") for c, _, r, t in TURNS]
    assert brute.ordered((r["conv_id"], r["role"], r["text"]) for r in back.collect()) == brute.ordered(plain)
    got = {r["conv_id"]: r for r in chat.digests(back).collect()}
    told = [t or "" for c, _, r, t in sorted((x for x in TURNS if x[0] == 1), key=lambda x: (x[1], x[2] or "", x[3] or ""))[1:]]
    assert got[1]["loss_sha256"] == brute.sha("".join(told)) and got[1]["loss_chars"] == len("".join(told))
    assert got[None]["n_turns"] == 1 and got[2]["turns_sha256"] == brute.sha("us:er\n#\n\\\n" + "assistant\n:\n\\l\n" * 2)
    assert chat.digests(chat.read_back(chat.format_turns(chat.canonical_turns(df.filter("false"))))).collect() == []


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"}, {"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"question": "q", "answer": "a"}, {"unknown": 1}, {"messages": "no list"},
    ]
    texts = [json.dumps(r) for r in records] + ["[1]", "not json", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, payload string")
    turns, rejects = chat.canonical_json(df, "id", "payload")
    got = {}
    for r in turns.orderBy("conv_id", "turn_no").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {k: ([("system", "s")] if k == 6 else []) + qa for k in range(8)}
    assert sorted(r["conv_id"] for r in rejects.collect()) == [8, 9, 10, 11, 12, 13]
    typed = spark.createDataFrame([(7, "q", "i", "a")], "key bigint, instruction string, input string, output string")
    assert [tuple(r)[2:] for r in chat.canonical_turns(typed, "key").collect()] == [("user", "q\ni"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(typed.withColumn("more", F.lit(1)), "key")


def test_line_alignment(spark, edge, nothing):
    distinct = {d: (d, t) for d, t, _ in EDGE if d is not None}
    menu = "\n".join(prose(60 + k, 6) for k in range(8))
    more = [(20, menu), (21, f"{prose(1, 9)}\n{menu}\n{prose(2, 9)}"), (22, "\n".join(reversed(menu.split("\n")))), (23, menu.upper()), (24, "a\n" * 50), (25, "a\n" * 60)]
    docs = sorted(distinct.values()) + more
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASHING})
    assert rows(line_align.digests(df, line_align.align(df))) == brute.aligned(docs)
    assert rows(line_align.digests(nothing, line_align.align(nothing))) == []
    repeated = line_align.digests(edge, line_align.align(edge))
    assert repeated.count() == len(EDGE)
    # A null id is the earliest; both rows of a repeated document get the same result.
    by_id = {}
    for r in repeated.collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[None][0]["n_removed"] == 0 and by_id[6][0]["n_removed"] == 1 and by_id[9][0] == by_id[9][1]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made, public_tokenizers.path("byte_bpe_50k.json")


def test_token_store(spark, edge, nothing, documents, tmp_path):
    import numpy as np

    made, path = tokenizer()
    for name, df, size in (("edge", edge, 500), ("documents", documents, 1 << 20)):
        where = f"file://{tmp_path}/{name}"
        token_store.write(df, where, path, shard_tokens=size)
        stored = token_store.read(spark, where)
        docs = sorted(pairs(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        start, wanted, seven = 0, [], 0
        for d, t in docs:
            ids = made.encode(t or "", add_special_tokens=False).ids + [0]
            wanted.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
            seven += ids.count(7)
        assert rows(token_store.documents(stored)) == brute.ordered(wanted)
        assert sum(r["n"] for r in token_store.counts(stored, 7).collect()) == seven == token_store.occurrences(stored, 7).count()
    token_store.write(nothing, f"file://{tmp_path}/nothing", path)
    assert token_store.documents(token_store.read(spark, f"file://{tmp_path}/nothing")).collect() == []


def test_encoder_cuts_safely():
    import numpy as np

    made, path = tokenizer()
    rng = random.Random(2)
    texts = ["".join(rng.choices(" \n\t\r\u2003a'stéB1,.#日\x1c\u00a0", k=rng.randint(1, 30))) for _ in range(3000)]
    for t, got in zip(texts, token_store.Encoder.of(path).encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u2").tolist() == made.encode(t, add_special_tokens=False).ids, repr(t)


def test_wavelet_matrix():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 7, 513, 3000):
        ids = rng.integers(0, 50_257, n).astype(np.uint16)
        ids[::5] = 13
        built = token_store.WaveletMatrix.build(ids)
        m = token_store.WaveletMatrix.load(n, built.zeros, built.payload())
        assert (m.decode() == ids).all() and [m.access(k) for k in range(0, n, 11)] == ids[::11].tolist()
        at = np.flatnonzero(ids == 13)
        assert m.occurrences(13).tolist() == at.tolist() and m.count(13, n // 3, n) == (ids[n // 3:] == 13).sum()
        assert [m.select(13, k) for k in (0, len(at) - 1)] == [at[0], at[-1]] and m.select(13, len(at)) == -1 and m.count(60_000) == 0


def test_pieces_are_encoded_as_the_tokenizer_does():
    """Words, stops, contractions, accents, white space and control characters; a NUL behind a blank begins no text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(11)
    stuff = ["foo", "Bar", "été", "ﬁn", "漢字", "don't", "I'LL", "'s", "x.", "y,", "...", ".", "3.14", "a1b", "#$%", "~", "’", "\t", "\n", "\r\n", "\x0b", "\x00", "\x00foo", "\x1f", "\x7f", "\x85", "\xa0", "×", "ǃ", "ɏ", "  ", " ", " ", " "]
    texts = ["foo \x00foo foo", *("".join(rng.choices(stuff, k=rng.randint(1, 12))) for _ in range(6000))]
    encoder = token_store.Encoder(path)
    wanted = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(memoryview(got).cast("H")) for got in encoder.encode(texts)] == wanted
    assert list(memoryview(token_store.Encoder(path).encode(["a foo", "b \x00foo"])[1]).cast("H")) == encoder.tokenizer.encode("b \x00foo").ids


def test_a_round_asks_once_for_each_piece():
    """Ordinary texts, texts with runs of blanks, null and empty ones in one call; words repeat, long pieces are not kept."""
    import public_tokenizers
    import pyarrow as pa

    class Counted(token_store.Known):
        asked = made = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

        def _part(self, part):
            self.made += part not in self
            return super()._part(part)

    rng = random.Random(12)
    words = ["foo", "Bar.", "été,", "end.\nStart", "###", "3.14", "don't", "a.b.", "..", ".", "漢字。", "x" * 300]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", " ", ".", "a.", " foo  Bar. \n foo", "foo ", "\tfoo\u2003 Bar.\n\n", "漢字" * 200, *texts[:5]]
    rng.shuffle(texts)
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder.known = Counted(encoder.tokenizer)
    given = pa.array(["not asked", *texts], pa.string())[1:]
    rounds = [(k, encoder.encode(some)) for k, some in token_store._rounds(pa.array(range(len(texts))), given)]
    assert [k for ks, _ in rounds for k in ks] == list(range(len(texts)))
    assert [list(memoryview(got).cast("H")) for _, some in rounds for got in some] == wanted
    assert encoder.known.asked < 60 and encoder.known.made < 60 and max(map(len, encoder.known)) <= token_store._KEEP_LENGTH
    assert encoder.encode([]) == [] == list(token_store._rounds(pa.array([], pa.int64()), pa.array([], pa.string())))
    assert encoder.encode(["foo"]) == encoder.encode(pa.array(["foo"])) and encoder.encode([None, ""]) == [b"", b""]


def test_rounds_end_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "_ROUND", 10)
    texts = ["a" * 9, None, "é", "b" * 30, "", "c" * 10, "d"]
    assert [(k, t.to_pylist()) for k, t in token_store._rounds(pa.array(range(7)), pa.array(texts))] == [
        ([0, 1, 2], texts[:3]), ([3], texts[3:4]), ([4, 5], texts[4:6]), ([6], texts[6:]),
    ]


def test_workers_keep_their_encoder(spark):
    """A worker process loads a tokenizer file once, not once a task."""
    import os

    import public_tokenizers
    import pyarrow as pa

    path, of = public_tokenizers.path("byte_bpe_50k.json"), token_store.Encoder.of

    def run(batches):
        for _ in batches:
            encoder = of(path)
            encoder.uses = getattr(encoder, "uses", 0) + 1
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "uses": [encoder.uses]})

    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(tasks, numPartitions=tasks).mapInArrow(run, "pid bigint, uses bigint").collect()
    assert len(rows) == tasks > len({r.pid for r in rows})
    for pid in {r.pid for r in rows}:
        uses = sorted(r.uses for r in rows if r.pid == pid)
        assert uses == list(range(1, len(uses) + 1))


def test_table_of_pieces_is_bounded(monkeypatch):
    """However many pieces come, also within one call, few are held; those asked for again stay."""
    import public_tokenizers

    monkeypatch.setattr(token_store, "_KEEP", 50)
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for first in range(0, 4000, 800):
        texts = [f"Often w{n}x, {n} and{n}b.c" for n in range(first, first + 800)]
        wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [list(memoryview(got).cast("H")) for got in encoder.encode(texts)] == wanted
        assert len(encoder.known) <= 50 and len(encoder.known.old) <= 50
    for n in range(200):
        assert encoder.encode([f"Often {n}z"]) and ("Often" in encoder.known or "Often" in encoder.known.old)
