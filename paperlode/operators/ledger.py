"""The result ledger: de-duplication, merging, normalising and pruning of four-column records."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode import rules
from paperlode.functions.basic import not_blank, strip
from paperlode.functions.urls import id_from_ledger_link, norm_url
from paperlode.operators.ranks import first_rows, position_block, row_numbers

PAPER, LINK, DESCRIPTION, TIME = rules.LEDGER_FIELDS


def dedupe_records(
    new: DataFrame, existing: DataFrame, order: list[str], prefer: str = "new", normalised: bool = True
) -> DataFrame:
    """One record per (paper, data set) pair.

    The current form prefers new rows, compares normalised URLs and drops records with a blank link;
    the older form (``prefer="old", normalised=False``) keeps existing rows and compares raw text.
    """
    batch = {"new": (0, 1), "old": (1, 0)}[prefer]
    rows = new.withColumn("__batch", F.lit(batch[0])).unionByName(existing.withColumn("__batch", F.lit(batch[1])))
    if normalised:
        rows = rows.filter(not_blank(F.col(PAPER)) & not_blank(F.col(LINK)))
        keys = [norm_url(F.col(PAPER)), norm_url(F.col(LINK))]
    else:
        keys = [strip(F.coalesce(F.col(c), F.lit(""))) for c in (PAPER, LINK)]
    keyed = rows.withColumns({"__k0": keys[0], "__k1": keys[1]})
    return first_rows(keyed, ["__k0", "__k1"], [F.col("__batch"), *[F.col(c) for c in order]]).drop(
        "__k0", "__k1", "__batch"
    )


def dedupe_link_corpus(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Link samples: existing first; the label is part of the key."""
    rows = existing.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    keyed = rows.withColumns({
        "__k0": norm_url(F.col(PAPER)),
        "__k1": norm_url(F.col("URL")),
        "__k2": F.coalesce(F.col("Label"), F.lit("")),
    })
    return first_rows(keyed, ["__k0", "__k1", "__k2"], [F.col("__batch"), *[F.col(c) for c in order]]).drop(
        "__k0", "__k1", "__k2", "__batch"
    )


def keep_last(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Last row per key at the position of its first one; partial results combine before the shuffle."""
    rest = [c for c in df.columns if c not in (key, pos)]
    return df.groupBy(key).agg(F.min(pos).alias(pos), F.max_by(F.struct(*rest), pos).alias("__r")).select(
        key, pos, "__r.*"
    )


def first_non_blank(
    df: DataFrame, keys: list[str], order: list[str], fields: list[str], position: str | None = None
) -> DataFrame:
    """First non-blank value of each field per key, in the given order.

    An aggregate with map-side combine, not a window: copies of one key are folded where they are read.
    """
    at = F.struct(*order)

    def pick(c: str) -> Column:
        filled = not_blank(F.col(c))
        return F.coalesce(F.min_by(F.when(filled, F.col(c)), F.when(filled, at)), F.lit("")).alias(c)

    extra = [F.min(at).alias(position)] if position else []
    return df.groupBy(*keys).agg(*[pick(c) for c in fields], *extra)


def merge_fill(existing: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """Merge new records into existing ones by versioned paper id.

    The first existing row of an id stays and later rows of other sources fill only its blank fields;
    repeats among existing rows fill nothing. Existing rows without an id stay as they are, new ones
    are dropped. ``pos`` orders each side; new rows may carry ``src`` as the rank of their source.
    """
    old = existing.withColumn("__id", id_from_ledger_link(F.col(PAPER)))
    old_first = first_rows(old.filter("__id is not null"), ["__id"], [F.col(pos)])
    fresh = new.withColumn("__id", id_from_ledger_link(F.col(PAPER))).filter("__id is not null")
    src = F.col("src") if "src" in new.columns else F.lit(0)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rules.LEDGER_FIELDS]
    rows = old_first.select("__id", F.lit(0).alias("__side"), F.lit(0).alias("__src"), F.col(pos).alias("__pos"), *fields).unionByName(
        fresh.select("__id", F.lit(1).alias("__side"), src.cast("int").alias("__src"), F.col(pos).alias("__pos"), *fields)
    )
    merged = first_non_blank(rows, ["__id"], ["__side", "__src", "__pos"], rules.LEDGER_FIELDS)
    unkeyed = old.filter("__id is null").select(*fields)
    return merged.select(*rules.LEDGER_FIELDS).unionByName(unkeyed)


def merge_fill_outer(existing: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The same rule for two sides with one row per key, as a full outer join."""
    a, b = existing.alias("a"), new.alias("b")
    filled = [
        F.coalesce(F.when(not_blank(F.col(f"a.`{c}`")), F.col(f"a.`{c}`")), F.col(f"b.`{c}`"), F.lit("")).alias(c)
        for c in fields
    ]
    return a.join(b, key, "full_outer").select(key, *filled)


def unkeyed_count(new: DataFrame) -> DataFrame:
    """How many new records carry no versioned id and would be dropped by the merge."""
    return new.agg(F.count_if(id_from_ledger_link(F.col(PAPER)).isNull()).alias("unkeyed"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Union in priority order; ``src`` is the rank of the source."""
    tagged = [s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def prune_blank(df: DataFrame, column: str = DESCRIPTION) -> DataFrame:
    return df.filter(not_blank(F.col(f"`{column}`")))


def require_links(df: DataFrame) -> DataFrame:
    return df.filter(not_blank(F.col(PAPER)) & not_blank(F.col(LINK)))


def normalise_fields(df: DataFrame, nameless: str | None = None) -> DataFrame:
    """The four fields first, as strings without nulls; other columns behind them.

    A nameless column that holds a pdf link stands in for a missing paper link and then goes.
    """
    have = set(df.columns)

    def field(c: str) -> Column:
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in have else F.lit("")
        if c == PAPER and nameless and c not in have:
            pdf = F.col(f"`{nameless}`")
            value = F.when(pdf.contains("arxiv.org/pdf/"), pdf).otherwise("")
        return value.alias(c)

    rest = [F.col(f"`{c}`") for c in df.columns if c not in rules.LEDGER_FIELDS and c != nameless]
    return df.select(*[field(c) for c in rules.LEDGER_FIELDS], *rest)


def distinct_in_order(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def global_index(df: DataFrame, category: str, page: str, item: str, name: str = "global_index") -> DataFrame:
    """Running index per category over result pages; a hot page is cut into blocks of a numeric item."""
    coarse = {"page": F.col(page)}
    if df.schema[item].dataType.typeName() in ("byte", "short", "integer", "long"):
        coarse["block"] = position_block(F.col(item))
    return row_numbers(df, [category], coarse, [F.col(item)], name)
