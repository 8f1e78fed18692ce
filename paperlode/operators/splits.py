"""Corpus shards and leak-free splits; a paper is never divided."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.operators.ranks import broadcast_limit, hash_block, hash_order, position_block, row_numbers
from paperlode.session import staged


def first_seen_papers(items: DataFrame, pos: str = "pos", sentences: Column | None = None) -> DataFrame:
    """One row per paper with first position and sentence count; blank names stand alone."""
    size = sentences if sentences is not None else F.lit(1)
    name = F.coalesce(
        F.when(F.trim(F.col("paper_name")) != "", F.col("paper_name")),
        F.concat(F.lit("__UNKNOWN__:"), F.col(pos).cast("string")),
    )
    return items.groupBy(name.alias("paper")).agg(
        F.min(pos).alias("first_pos"), F.sum(size).cast("long").alias("size"), F.count(F.lit(1)).alias("items")
    )


def equal_shards(papers: DataFrame, k: int) -> DataFrame:
    """Blocks of ceil(n / k) papers in first-seen order, shards from 0."""
    n = papers.agg(F.count(F.lit(1))).scalar()
    per = F.ceil(n / F.greatest(F.lit(1), F.least(F.lit(k), n)))
    numbered = row_numbers(papers, [], {"block": position_block(F.col("first_pos"))}, [F.col("first_pos")], "rn")
    return numbered.withColumn("shard", F.floor(F.col("rn") / per).cast("int")).drop("rn")


def balanced_shards(papers: DataFrame, k: int) -> DataFrame:
    """Longest paper first to the least loaded shard (the lowest number on ties), shards from 0.

    Papers of one size are alike, so the greedy order needs only the histogram of sizes. A corpus of
    S sentences has at most sqrt(2 S) distinct sizes; that histogram is folded in one task and gives
    the shard loads in front of each size. Every paper then finds its shard from its rank within its
    size, in parallel.
    """
    ranked = row_numbers(
        papers, ["size"], {"block": position_block(F.col("first_pos"))}, [F.col("first_pos")], "__rank"
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        loads, out = np.zeros(k, dtype=np.int64), []
        for size, n in pdf.sort_values("size", ascending=False)[["size", "n"]].itertuples(index=False):
            out.append(loads.tolist())
            loads = loads + size * shard_counts(loads, int(size), int(n))
        return pd.DataFrame({"size": sorted(pdf["size"], reverse=True), "loads": out})

    histogram = papers.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    before = histogram.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, "size LONG, loads ARRAY<LONG>")

    @F.pandas_udf("int")
    def place(sizes: pd.Series, loads: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(shards_of(np.stack(loads.to_numpy()), sizes.to_numpy(), ranks.to_numpy()), dtype="int32")

    # k loads per distinct size, at most sqrt(2 S) sizes for S sentences: broadcast within the session's limit by count,
    # so papers of a frequent size stay where they are; else a shuffle join.
    before = staged(before, "loads")
    if before.count() * k * 8 <= broadcast_limit(papers.sparkSession):
        before = F.broadcast(before)
    return ranked.join(before, "size").withColumn("shard", place("size", "loads", "__rank")).drop("loads", "__rank")


def _levels(loads: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the highest load level below which all items are among the first ``n``, and their counts.

    An equal item goes to the lowest load in front of it, so the first ``n`` items are the ``n`` smallest
    (load, number) pairs. The level is found by bisection for all rows at once.
    """
    step = sizes[:, None]

    def below(level: np.ndarray) -> np.ndarray:
        return np.maximum(0, -(-(level[:, None] - loads) // step))

    low, high = loads.min(axis=1), loads.max(axis=1) + sizes * (n // loads.shape[1] + 1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        fits = below(middle).sum(axis=1) <= n
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low, below(low)


def shard_counts(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of ``n`` equal items each shard takes when each goes to the least loaded one."""
    counts = np.zeros(len(loads), dtype=np.int64)
    if size == 0:
        counts[int(np.argmin(loads))] = n  # items of size 0 change no load
        return counts
    level, below = _levels(loads[None, :], np.array([size]), np.array([n]))
    counts = below[0]
    # The rest goes one each to the shards that stand at the level, in their order.
    for i in np.flatnonzero(loads + counts * size == level[0])[: n - int(counts.sum())]:
        counts[i] += 1
    return counts


def shards_of(loads: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shard of each item from the loads in front of its size and its rank among equal items."""
    level, counts = _levels(loads, np.maximum(sizes, 1), ranks)
    at_level = loads + counts * sizes[:, None] == level[:, None]
    wanted = (ranks - counts.sum(axis=1))[:, None]
    shard = np.argmax(at_level & (np.cumsum(at_level, axis=1) - 1 == wanted), axis=1)
    return np.where(sizes == 0, np.argmin(loads, axis=1), shard)


def adjust_by_papers(papers: DataFrame, seed: str = "42", parts: float = 12.0) -> DataFrame:
    """Move whole papers between train and test until test holds round(n / 12) papers.

    ``papers`` has paper and split ("train" or "test"). Which papers move is decided by a hash order.
    """
    totals = papers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    need = totals.select(F.bround(F.col("n") / parts).cast("long") - F.col("t")).scalar()
    hashed = papers.withColumn("__h", hash_order(seed, F.col("paper")))
    numbered = row_numbers(hashed, ["split"], {"block": hash_block(F.col("__h"))}, [F.col("__h"), F.col("paper")], "__rn")
    moved = (
        F.when((F.col("split") == "train") & (F.col("__rn") < need), "test")
        .when((F.col("split") == "test") & (F.col("__rn") < -need), "train")
        .otherwise(F.col("split"))
    )
    return numbered.withColumn("split", moved).drop("__h", "__rn")


def adjust_by_sentences(papers: DataFrame, seed: str = "42", parts: float = 12.0, steps: int = 3) -> DataFrame:
    """Move up to three of the largest papers so that test comes closer to 1/12 of the sentences.

    ``papers`` has paper, split and size. Each step moves the largest paper not yet moved that began
    on the side with too many sentences; the result is kept only if it is closer than before. Only the
    ``steps`` largest papers of each side (at most six rows) reach the driver.
    """
    total, test = papers.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("split") == "test", F.col("size"))), F.lit(0))
    ).first()
    hashed = papers.withColumn("__h", hash_order(seed, F.col("paper")))
    window = Window.partitionBy("split").orderBy(F.col("size").desc(), "__h", "paper")
    largest = hashed.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= steps)
    stock = {"train": [], "test": []}
    for row in largest.orderBy("rn").select("split", "paper", "size").collect():
        stock[row["split"]].append((row["paper"], row["size"]))
    target, now, moves = round(total / parts), test, {}
    for _ in range(steps):
        side, other, sign = ("train", "test", 1) if now < target else ("test", "train", -1)
        if now == target or not stock[side]:
            break
        paper, size = stock[side].pop(0)
        moves[paper] = other
        now += sign * size
    if abs(now - target) >= abs(test - target):
        return papers
    split = F.col("split")
    for paper, other in moves.items():
        split = F.when(F.col("paper") == paper, other).otherwise(split)
    return papers.withColumn("split", split)


def stratified_split(
    samples: DataFrame, label: str, key: str, train_size: int = 4000, test_share: float = 0.1, seed: str = "42"
) -> DataFrame:
    """Train and eval parts with equal label shares; a fixed train size, or 90/10 for small sets.

    Each label gets its rounded share of the train size, in hash order.
    """
    n = samples.agg(F.count(F.lit(1))).scalar()
    share = F.when(n <= train_size, F.lit(1.0 - test_share)).otherwise(F.lit(float(train_size)) / n)
    sizes = samples.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumn("__quota", F.round(F.col("__n") * share))
    hashed = samples.withColumn("__h", hash_order(seed, F.col(key)))
    numbered = row_numbers(hashed, [label], {"block": hash_block(F.col("__h"))}, [F.col("__h"), F.col(key)], "__rn")
    # Labels are few; the join side is the label histogram.
    return (
        numbered.join(sizes, label)
        .withColumn("part", F.when(F.col("__rn") < F.col("__quota"), "train").otherwise("eval"))
        .drop("__h", "__rn", "__n", "__quota")
    )


def paper_split(papers: DataFrame, share: float = 0.1, seed: str = "42") -> DataFrame:
    """Validation part of whole papers: ceil(share * n) of them in hash order."""
    n = papers.agg(F.count(F.lit(1))).scalar()
    hashed = papers.withColumn("__h", hash_order(seed, F.col("paper")))
    numbered = row_numbers(hashed, [], {"block": hash_block(F.col("__h"))}, [F.col("__h"), F.col("paper")], "__rn")
    part = F.when(F.col("__rn") < F.ceil(n * F.lit(share)), "validation").otherwise("train")
    return numbered.withColumn("part", part).drop("__h", "__rn")


def suggest_test_size(papers: DataFrame) -> DataFrame:
    """Share of the train papers that makes validation 1/12 of all papers."""
    n, train = F.count(F.lit(1)), F.count_if(F.col("split") == "train")
    wanted = F.bround(n / 12.0)
    return papers.agg(F.round(F.when(train > 0, wanted / train).otherwise(0.0), 6).alias("test_size"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows in hash order; repeatable."""
    return df.withColumn("__h", hash_order(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def shard_index(items: DataFrame, size: Column) -> DataFrame:
    """Paragraphs and sentences per shard and paper."""
    return items.groupBy("shard", "paper_name").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(size).cast("long").alias("sentences")
    )


def shard_summary(index: DataFrame) -> DataFrame:
    """Totals per shard and overall."""
    return index.rollup("shard").agg(
        F.grouping("shard").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("papers"),
        F.sum("paragraphs").cast("long").alias("paragraphs"),
        F.sum("sentences").cast("long").alias("sentences"),
    )


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Multiset of (keys, sha1 of the text) with counts."""
    return rows.groupBy(*keys, F.sha1(text).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number differs between two tables; empty means lossless. One shuffle of partial counts."""
    both = a.select(*columns, F.lit(1).alias("__d")).unionAll(b.select(*columns, F.lit(-1).alias("__d")))
    return both.groupBy(*columns).agg(F.sum("__d").alias("difference")).filter("difference <> 0")


def assert_lossless(original: DataFrame, shards: DataFrame, columns: list[str]) -> None:
    lost = multiset_difference(original, shards, columns).limit(1).count()
    if lost:
        raise AssertionError("shards lose, repeat or change rows")
