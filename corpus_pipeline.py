"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes the documents that the one before kept, applies one operator to all of them, and returns documents
with the same columns; the last one writes token files and returns what they hold. ``n_chars`` follows the text where
a stage changes it (lines that are frequent on a host go; documents at the end of a source's share are cut; a
document that the mix takes twice comes twice). Ids may be null or repeated: a row is known by id and text, and one row
of each group of near copies stays.

No SQL gives the same rows: the mix deals documents by a hash order that DuckDB lacks. Tests run the stages against
brute force.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm import decontaminate, line_quality, mixing, near_dedup, token_store
from paperlode.llm.tables import new_folder, table


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_quality.apply(docs, line_quality.assess(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.apply(docs, near_dedup.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.apply(docs, decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mix(docs)
    return _recounted(mixing.apply(docs, documents, pieces))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-shards")
    token_store.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.documents(token_store.read(spark, path))


STAGES = [
    ("quality rules", quality), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token files", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
