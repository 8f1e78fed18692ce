"""Sinks. Every write is one version (:mod:`paperlode.sources.versions`): it becomes visible whole or not at all, and
partitioned sinks replace only the partitions they write."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.sources.versions import read_version, write_version

DAY_CATEGORY = ["day", "category"]


def write_metadata(papers: DataFrame, path: str, covered: list[tuple[str, str]] | None = None) -> None:
    """One JSON partition per day and category, replaced as a whole.

    ``covered`` lists the (day, category) pairs that the run looked at; a pair without papers loses its old partition.
    """
    write_version(papers, path, DAY_CATEGORY, "json", covered=covered)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_metadata` wrote; filters on day and category skip whole partitions."""
    return read_version(spark, path, schema, "json", DAY_CATEGORY)


def append_samples(samples: DataFrame, path: str) -> None:
    """Labelled link samples as JSON lines per day and category."""
    write_version(samples, path, DAY_CATEGORY, "json", append=True)


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_version(spark, path, schema, "json", DAY_CATEGORY)


def link_samples(links: DataFrame, inputs: DataFrame, labels: DataFrame, keys: list[str], window: dict) -> DataFrame:
    """Link, classifier input and label side by side with the window parameters."""
    joined = links.join(inputs, keys).join(labels, keys)
    return joined.withColumns({k: F.lit(v) for k, v in window.items()})


def write_csv(table: DataFrame, path: str) -> None:
    write_version(table, path, [], "csv", options={"header": True})


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_version(spark, path, schema, "csv", [], options={"header": True})


def write_experiment(rankings: DataFrame, scores: DataFrame, path: str, name: str) -> None:
    """Rankings and mean scores of one experiment below its name."""
    for kind, table in (("result", rankings), ("score", scores)):
        write_version(table.withColumn("experiment", F.lit(name)), f"{path}/{kind}", ["experiment"], "json")


def read_experiment(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rankings (``result``) or mean scores (``score``) of all experiments."""
    return read_version(spark, f"{path}/{kind}", schema, "json", ["experiment"])
