"""Line alignment against a brute force that aligns every document with every earlier one."""

import random

import brute
from test_llm_operators import prose

from paperlode.llm import line_align


def cuts(docs, min_words=20):
    """docs with distinct ids, in order. Of increasing runs of equal length the operator's own choice counts."""
    split = {d: [brute.normal(x) for x in t.split("\n")] for d, t in docs}
    words = {d: [len(brute.words(x)) for x in lines] for d, lines in split.items()}
    out = {}
    for k, (d, _) in enumerate(docs):
        found = [line_align.doomed(split[d], words[d], split[e], min_words) for e, _ in docs[:k]]
        out[d] = sorted({i for cut in found for i in cut})
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: list(r["cut"]) for r in line_align.align(df).collect()}
    assert got == cuts(docs)
    return got


def test_copy_behind_a_document_with_all_its_lines(spark):
    held = [prose(500 + k, 6) for k in range(6)]
    first = "\n".join(f"{held[k]}\n{prose(520 + k, 5)}" for k in (3, 1, 5, 0, 4, 2))
    got = check(spark, [(1, first), (2, "\n".join(held)), (3, "\n".join(held).upper()), (4, "\n".join([prose(540, 30), *held]))])
    assert got == {1: [], 2: [], 3: [0, 1, 2, 3, 4, 5], 4: [1, 2, 3, 4, 5, 6]}


def test_lines_that_the_first_holders_leave(spark):
    """Passages in other orders, repeated, with gaps, with blank lines, and with single lines of 20 words."""
    rng = random.Random(6)
    passages = ["\n".join(prose(600 + 10 * p + k, rng.choice([3, 7, 25])) for k in range(4)) for p in range(6)] + ["a\n\nb\n" * 12]
    docs = []
    for d in range(28):
        parts = rng.choices(passages, k=rng.randint(1, 7)) + [prose(900 + d, 9)]
        rng.shuffle(parts)
        lines = "\n".join(parts).split("\n")
        docs.append((d, "\n".join(x for x in lines if rng.random() < 0.97)))
    assert sum(map(len, check(spark, docs).values())) > 100


def test_rounds_do_not_multiply_the_planners_sizes(spark):
    """A passage twice in the last document meets all 12 holders, in four rounds."""
    passage = "\n".join(prose(1000 + k, 8) for k in range(4))
    docs = [(d, f"{prose(1100 + d, 6)}\n{passage}\n{prose(1300 + d, 6)}") for d in range(12)]
    docs.append((12, f"{passage}\n{prose(1500, 6)}\n{passage}"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    aligned = line_align.align(df)
    size = aligned._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 4000
    assert {r["doc_id"]: list(r["cut"]) for r in aligned.collect()} == cuts(docs)
