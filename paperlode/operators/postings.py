"""Keyword search on an index of character grams: only records that can match are read and scored.

Every word of a record gives its grams of one to ``GRAMS`` characters. The index holds, for each gram and bucket of
records, the sorted keys of the records, as differences of the least width that fits. A search reads the grams of its
words, meets their lists bucket by bucket, and scores the records found by ``keyword_search``; rows and scores are those
of a search through all records. No list is longer than a bucket, so a gram that all records have is many lists.

Keys are whole numbers and name one record each; records of one key are found together. Null fields count as empty;
records without words are in no list. An index of an empty table is empty, and finds nothing.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.operators.retrieval import keyword_search, latest_records

GRAMS = 3
BUCKET_RECORDS = 20_000
POSTINGS = "term STRING, bucket BIGINT, least BIGINT, width INT, gaps BINARY"
FIELDS = ["Paper Link", "Dataset Link", "Dataset Description"]


def index_grams(words: set[str]) -> set[str]:
    """All grams of the words, whatever their place."""
    return {w[i:i + n] for w in words for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)}


def search_grams(word: str) -> set[str]:
    """Grams that a record with the word must have; they are in the index."""
    return {word[i:i + GRAMS] for i in range(max(1, len(word) - GRAMS + 1))}


def packed_keys(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(least, width, gaps) of sorted distinct keys."""
    gaps = np.diff(keys, prepend=keys[:1]).astype(np.uint64)
    top = int(gaps.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return int(keys[0]), width, gaps.astype(f"<u{width}").tobytes()


def unpacked_keys(least: int, width: int, gaps: bytes) -> np.ndarray:
    return least + np.cumsum(np.frombuffer(gaps, dtype=f"<u{width}").astype(np.int64))


def write_postings(
    records: DataFrame, path: str, key: str, fields: list[str] | None = None, bucket_records: int = BUCKET_RECORDS
) -> None:
    """Write the index of ``records`` to ``path``, ordered by gram, so that a search skips most of its row groups."""
    names = fields or FIELDS
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
    buckets = records.select(key).count() // bucket_records + 1
    # The bucket follows from the key: a task that runs again gives the same lists.
    bucket = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(buckets))
    rows = records.select(F.col(key).cast("bigint").alias("key"), bucket.alias("bucket"), text.alias("text"))

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, part in pdf.groupby("bucket"):
                found: dict[str, list[int]] = {}
                for k, t in zip(part["key"].tolist(), part["text"], strict=True):
                    for gram in index_grams(set(t.split())):
                        found.setdefault(gram, []).append(k)
                packed = [packed_keys(np.unique(np.array(v, dtype=np.int64))) for v in found.values()]
                yield pd.DataFrame({
                    "term": list(found), "bucket": number, "least": [p[0] for p in packed],
                    "width": [p[1] for p in packed], "gaps": [p[2] for p in packed],
                })

    placed = rows.repartition(buckets, "bucket")
    made = placed.mapInPandas(lists, POSTINGS)
    made.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(path)


def matching_keys(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """Keys of the records that have all grams of some token: (key)."""
    wanted = [sorted(search_grams(t)) for t in dict.fromkeys(tokens)]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lists: dict[str, np.ndarray] = {}
        for term, least, width, gaps in zip(pdf["term"], pdf["least"], pdf["width"], pdf["gaps"], strict=True):
            lists[term] = np.union1d(lists.get(term, np.zeros(0, dtype=np.int64)), unpacked_keys(least, width, gaps))
        whole = [reduce(np.intersect1d, [lists[g] for g in grams]) for grams in wanted if all(g in lists for g in grams)]
        return pd.DataFrame({"key": reduce(np.union1d, whole, np.zeros(0, dtype=np.int64))})

    terms = sorted({g for grams in wanted for g in grams})
    rows = spark.read.schema(POSTINGS).parquet(path).filter(F.col("term").isin(terms))
    return rows.groupBy("bucket").applyInPandas(meet, "key BIGINT")


def search_postings(
    records: DataFrame, path: str, query: str, key: str, limit: int = 50, fields: list[str] | None = None, tie: list[str | Column] | None = None
) -> DataFrame:
    """As ``keyword_search`` over ``records``, whose index lies at ``path``: only records with the grams of a word are scored."""
    tokens = [t.lower() for t in (query or "").split()]
    if not tokens:
        return latest_records(records, limit, tie=tie)
    found = matching_keys(records.sparkSession, path, tokens).withColumnRenamed("key", "__key")
    near = records.join(found, F.col(key).cast("bigint") == F.col("__key"), "left_semi")
    return keyword_search(near, query, limit, fields, tie)
