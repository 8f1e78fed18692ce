"""Row filters and equi-join lookups of the intake."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions.basic import blank_to_null
from paperlode.functions.responses import (
    heuristic_label,
    heuristic_reason,
    normalized_label,
    normalized_reason,
)
from paperlode.functions.text import short_description
from paperlode.operators.ranks import first_rows


def gate(df: DataFrame, threshold: float = 0.5, prob: str = "gate_prob") -> DataFrame:
    return df.filter(F.col(prob) >= threshold)


def on_day(df: DataFrame, day: str, column: str = "published", look_back_days: int | None = None) -> DataFrame:
    """Rows of the target day; with a look-back span the day is not checked."""
    return df if look_back_days else df.filter(F.substring(F.col(column).cast("string"), 1, 10) == day)


def look_back(df: DataFrame, category: str, days: int, now: Column, column: str = "updated") -> DataFrame:
    """Rows of a category in [now - days, now]; both bounds reach the scan."""
    return df.filter(
        (F.col("category") == category) & F.col(column).between(now - F.make_dt_interval(F.lit(days)), now)
    )


def in_range(df: DataFrame, start: Column, end: Column, column: str = "published") -> DataFrame:
    """Both bounds inclusive."""
    return df.filter(F.col(column).between(start, end))


def unseen(entries: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Entries whose id is not in the history of any category."""
    return entries.join(seen.select(key), key, "left_anti")


def seen_ids(histories: DataFrame) -> DataFrame:
    return histories.select("id").distinct()


def one_owner(entries: DataFrame, rank: Column, order: list[str]) -> DataFrame:
    """One row per id: the category that ranks first owns it."""
    return first_rows(entries, ["id"], [rank, *[F.col(c) for c in order]])


def category_rank(category: Column, categories: list[str]) -> Column:
    position = F.array_position(F.array(*[F.lit(c) for c in categories]), category)
    return F.when(position > 0, position).otherwise(len(categories) + 1)


def url_of_sample(predictions: DataFrame, papers: DataFrame, category: str) -> DataFrame:
    """Urls of predicted samples, found by their running number, in prediction order."""
    side = papers.filter(F.col("category") == category).select(F.col("count").alias("Sample"), "url")
    return predictions.join(side, "Sample").select("pos", "Sample", "url").orderBy("pos")


def zip_by_position(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share keys and position."""
    return left.join(right, keys)


def align_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One classified row per request; missing answers fall back to the clue words.

    ``requests`` has batch_id, idx, url, context; ``responses`` has batch_id and items (array). Answers
    beyond the batch are dropped.
    """
    answers = responses.select("batch_id", F.posexplode("items").alias("idx", "a"))
    joined = requests.join(answers, ["batch_id", "idx"], "left")
    ctx, given = F.col("context"), F.col("a").isNotNull()
    return joined.select(
        "batch_id",
        "idx",
        F.coalesce(blank_to_null(F.col("a.url")), F.col("url")).alias("url"),
        F.when(given, normalized_label(F.col("a.label"), ctx)).otherwise(heuristic_label(ctx)).alias("label"),
        F.when(given, normalized_reason(F.col("a.label"), F.col("a.why"), ctx)).otherwise(heuristic_reason(ctx)).alias("why"),
        F.coalesce(blank_to_null(F.col("a.desc")), short_description(ctx)).alias("desc"),
    )
