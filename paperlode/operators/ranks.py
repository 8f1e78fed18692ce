"""Row numbers, running sums and as-of lookups that spread a hot key over many tasks.

A plain window puts one key into one task. Here the caller names a coarse column that grows with the
order (a block of positions, a hash prefix, a score). Totals per key and coarse value are
pre-aggregated on the map side, accumulated on that small table, and joined back; the row-level
window then runs per key AND coarse value. The big side is shuffled once.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def position_block(c: Column, size: int = 65536) -> Column:
    """Coarse value of a numeric position."""
    return F.floor(c / size).cast("long")


def hash_order(seed: str, *cols: Column) -> Column:
    """Deterministic pseudo-random order key; recomputed alike after a lost executor."""
    return F.md5(F.concat(F.lit(seed), *[c.cast("string") for c in cols]))


def hash_block(h: Column) -> Column:
    """Coarse value of a hash order key: 65536 even blocks."""
    return F.substring(h, 1, 4)


def _keyed(df: DataFrame, keys: list[str], coarse: dict[str, Column]) -> tuple[DataFrame, list[str], list[str]]:
    """Columns to group by that hold no null: values with a default, behind a mark that sorts null first.

    Totals, join and window all use the same plain columns, so they share one hash partitioning.
    """
    made = df.withColumns({f"__c_{n}": c for n, c in coarse.items()})
    names: list[list[str]] = []
    for source in [*keys, *[f"__c_{n}" for n in coarse]]:
        field = made.schema[source]
        if not field.nullable:
            names.append([source])
            continue
        value, mark = f"__v_{source}", f"__n_{source}"
        default = F.lit("") if field.dataType.typeName() == "string" else F.lit(0).cast(field.dataType)
        made = made.withColumns({value: F.coalesce(F.col(f"`{source}`"), default), mark: F.col(f"`{source}`").isNotNull()})
        names.append([mark, value])
    key_names = [n for group in names[: len(keys)] for n in group]
    block_names = [n for group in names[len(keys):] for n in group]
    return made, key_names, block_names


def running_total(
    df: DataFrame,
    keys: list[str],
    coarse: dict[str, Column],
    order: list[Column],
    size: Column,
    name: str,
) -> DataFrame:
    """Sum of ``size`` over all earlier rows of the key, as column ``name`` (0 for the first row)."""
    marked, by, blocks = _keyed(df, keys, coarse)
    marked = marked.withColumn("__size", size.cast("long"))
    totals = (
        marked.groupBy(*by, *blocks)
        .agg(F.sum("__size").alias("__total"))
        .withColumn("__start", F.sum("__total").over(Window.partitionBy(*by).orderBy(*blocks).rowsBetween(*_BEFORE)))
        .drop("__total")
    )
    inner = Window.partitionBy(*by, *blocks).orderBy(*order).rowsBetween(*_BEFORE)
    local = F.coalesce(F.sum("__size").over(inner), F.lit(0))
    joined = marked.join(totals, [*by, *blocks], "left")
    return joined.withColumn(name, local + F.coalesce(F.col("__start"), F.lit(0))).select(*[f"`{c}`" for c in df.columns], name)


def row_numbers(
    df: DataFrame, keys: list[str], coarse: dict[str, Column], order: list[Column], name: str
) -> DataFrame:
    """Row number from 0 in the order of the key."""
    return running_total(df, keys, coarse, order, F.lit(1), name)


def last_seen(
    df: DataFrame, keys: list[str], coarse: dict[str, Column], order: list[str], value: str, name: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row (as-of lookup)."""
    marked, by, blocks = _keyed(df, keys, coarse)
    order_key = F.when(F.col(value).isNotNull(), F.struct(*order))
    totals = (
        marked.groupBy(*by, *blocks)
        .agg(F.max_by(value, order_key).alias("__block_last"))
        .withColumn(
            "__carry",
            F.last("__block_last", ignorenulls=True).over(
                Window.partitionBy(*by).orderBy(*blocks).rowsBetween(*_BEFORE)
            ),
        )
        .drop("__block_last")
    )
    inner = Window.partitionBy(*by, *blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(value, ignorenulls=True).over(inner)
    joined = marked.join(totals, [*by, *blocks], "left")
    return joined.withColumn(name, F.coalesce(here, F.col("__carry"))).select(*[f"`{c}`" for c in df.columns], name)


def first_rows(df: DataFrame, keys: list[Column | str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key. The limit is applied before the shuffle, so a hot key stays cheap."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= k).drop("__rn")


def top_rows(df: DataFrame, keys: list[Column | str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def broadcast_limit(spark: SparkSession) -> int:
    """Largest table in bytes that may be broadcast; follows the session's own limit."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower().rstrip("b")
    scale = {"k": 2**10, "m": 2**20, "g": 2**30}.get(text[-1:], 1)
    return int(float(text.rstrip("kmg")) * scale)
