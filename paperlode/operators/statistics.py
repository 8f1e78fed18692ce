"""Corpus statistics per category and year."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.basic import blank_to_null
from paperlode.functions.dates import in_utc, utc, year_of
from paperlode.operators.ranks import first_rows


def share_by_category(papers: DataFrame, test: Column, category: str = "category", digits: int = 2) -> DataFrame:
    """Count, hits and percentage per category."""
    n, hits = F.count(F.lit(1)), F.count_if(test)
    return papers.groupBy(category).agg(n.alias("total"), hits.alias("hits"), F.round(100.0 * hits / n, digits).alias("percent"))


def share_with_total(papers: DataFrame, test: Column, category: str = "category", digits: int = 2) -> DataFrame:
    """The same with a grand total row; an empty input gives a total of 0."""
    n, hits = F.count(F.lit(1)), F.count_if(test)
    ratio = F.when(n > 0, F.round(100.0 * hits / n, digits)).otherwise(0.0)
    rolled = papers.rollup(category).agg(
        F.grouping(category).alias("__all"), n.alias("total"), hits.alias("hits"), ratio.alias("percent")
    )
    name = F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(category))
    return rolled.select(name.alias(category), "total", "hits", "percent")


def paper_year(published: Column, updated: Column) -> Column:
    return year_of(F.coalesce(F.when(published != "", published), updated))


def yearly_counts(papers: DataFrame, first: int, last: int, passed: Column, year: Column) -> DataFrame:
    """Distinct papers per year that pass the gate; missing years count 0.

    The first row in (category_rank, pos) order represents an id.
    """
    known = papers.filter(blank_to_null(F.col("id")).isNotNull()).withColumn("year", year)
    unique = first_rows(known.filter(F.col("year").between(first, last)), ["id"], [F.col("category_rank"), F.col("pos")])
    counted = unique.filter(passed).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    years = papers.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(counted, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("count"))


def year_by_owner(papers: DataFrame, year: int, of: Column, passed: Column) -> DataFrame:
    """Papers of one year that pass the gate, per category and in total; the first category that lists an id owns it."""
    rows = papers.filter(blank_to_null(F.col("id")).isNotNull() & (of == year))
    owned = first_rows(rows, ["id"], [F.col("category_rank"), F.col("pos")]).filter(passed)
    rolled = owned.rollup("category").agg(F.grouping("category").alias("__all"), F.count(F.lit(1)).alias("count"))
    return rolled.select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "count")


def category_by_year(papers: DataFrame, year: Column, category: str, categories: list[str]) -> DataFrame:
    """One row per year, one column per category, and the yearly total."""
    counted = papers.withColumn("year", year).groupBy("year").agg(
        *[F.count_if(F.col(category) == c).alias(c) for c in categories], F.count(F.lit(1)).alias("total")
    )
    return counted


def kept_ratio(papers: DataFrame, kept: Column, keys: list[str]) -> DataFrame:
    """Kept and total per group, ratio with 4 digits."""
    n, k = F.count(F.lit(1)), F.count_if(kept)
    return papers.groupBy(*keys).agg(
        n.alias("total"), k.alias("kept"), F.round(F.when(n > 0, k / n).otherwise(0.0), 4).alias("ratio")
    )


def source_coverage(papers: DataFrame, has_source: Column) -> DataFrame:
    """Papers with a source, all papers, and the share in percent (0 for none)."""
    n, have = F.count(F.lit(1)), F.count_if(has_source)
    return papers.agg(
        have.alias("have"), n.alias("total"), F.round(F.when(n > 0, 100.0 * have / n).otherwise(0.0), 2).alias("percent")
    )


def corpus_size(items: DataFrame, sentences: str = "sentences") -> DataFrame:
    """Distinct papers, paragraph items and sentences."""
    return items.agg(
        F.countDistinct("paper_name").alias("papers"),
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum(F.size(sentences)), F.lit(0)).cast("long").alias("sentences"),
    )


def update_span(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with newest and oldest update per page; unreadable times are skipped."""
    ts = in_utc(utc(F.col("updated")))
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.date_format(F.max(ts), iso).alias("newest"),
        F.date_format(F.min(ts), iso).alias("oldest"),
    )


def token_usage(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Token totals of the answers per paper."""
    return responses.groupBy(*keys).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")]
    )
