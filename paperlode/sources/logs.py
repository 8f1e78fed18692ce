"""Stage times and coverage from run logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode import rules

_STAGE_LINE = r"\[TIME\]\[([^\]]*)\] (\w+) = (\d+) ms"


def stage_times(lines: DataFrame, value: str = "value") -> DataFrame:
    """(paper_id, stage, ms) of timing lines."""
    rows = lines.select(*[F.regexp_extract(value, _STAGE_LINE, i).alias(n) for i, n in ((1, "paper_id"), (2, "stage"), (3, "ms"))])
    return rows.filter("stage <> ''").withColumn("ms", F.col("ms").cast("long"))


def stage_report(times: DataFrame, limits: list[tuple[str, int]] = rules.STAGE_LIMITS_MS) -> DataFrame:
    """Runs, mean, maximum and slow runs per stage; stages without a limit are never slow."""
    limit: Column = F.lit(None).cast("long")
    for name, ms in limits:
        limit = F.when(F.col("stage") == name, ms).otherwise(limit)
    return times.groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("ms"), 3).alias("mean_ms"),
        F.max("ms").alias("max_ms"),
        F.count_if(F.coalesce(F.col("ms") > limit, F.lit(False))).alias("slow_runs"),
    )


def coverage_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(category, total, has, no, unknown, percent) of coverage summary lines."""
    pattern = r"(\S+)\s+total=\s*(\d+)\s+HAS=\s*(\d+)\s+NO=\s*(\d+)\s+UNKNOWN=\s*(\d+)"
    names = ["category", "total", "has", "no", "unknown"]
    rows = lines.select(*[F.regexp_extract(value, pattern, i + 1).alias(n) for i, n in enumerate(names)])
    rows = rows.filter("category <> ''").select("category", *[F.col(n).cast("long").alias(n) for n in names[1:]])
    known = F.col("total") - F.col("unknown")
    return rows.withColumn("percent", F.round(F.when(known > 0, 100.0 * F.col("has") / known).otherwise(0.0), 2))
