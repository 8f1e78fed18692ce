"""From link occurrences to one ranked primary link per paper."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.config import LinkConfig
from paperlode.operators.links import build_candidates, final_records, resolve_primary


def primary_links(links: DataFrame, order: list[str], external: DataFrame | None = None, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Distinct scored candidates of each paper and the link that wins: (paper_id, picked_by, url, why, score)."""
    cands = build_candidates(links, order, cfg)
    at = F.struct(*order)
    return resolve_primary(cands.withColumn("pos", at), external, cfg)


def ledger_records(
    papers: DataFrame, links: DataFrame, order: list[str], timestamp: Column, external: DataFrame | None = None, cfg: LinkConfig = LinkConfig()
) -> DataFrame:
    """Ledger records of the primary links."""
    picks = primary_links(links, order, external, cfg).withColumn("desc", F.lit(""))
    return final_records(papers, picks, timestamp, cfg.strict)
