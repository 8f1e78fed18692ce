"""Batch consolidation of all ledger sources into one table."""

from pyspark.sql import DataFrame

from paperlode.operators.ledger import merge_fill, normalise_fields, prune_blank, union_sources


def consolidate(existing: DataFrame, sources: list[DataFrame], pos: str = "pos", prune: bool = True) -> DataFrame:
    """Existing rows first, later sources in priority order fill blanks; rows without description go."""
    prepared = [normalise_fields(s) for s in sources]
    merged = merge_fill(normalise_fields(existing), union_sources(prepared), pos)
    return prune_blank(merged) if prune else merged
