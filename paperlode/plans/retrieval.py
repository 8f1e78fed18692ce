"""Retrieval experiments: encode, search, score and save in one job."""

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.hooks import Encoder
from paperlode.operators.retrieval import (
    cosine_top_k,
    mean_metrics,
    ranking_metrics,
    search_text,
    with_instruction,
)
from paperlode.session import staged
from paperlode.sources.sinks import write_experiment


def retrieve(
    queries: DataFrame, cands: DataFrame, encoder: Encoder, k: int, instruction: bool = False
) -> DataFrame:
    """Best ``k`` candidates of every query: (query_id, cand_id, score, rank).

    ``queries`` has query_id, query and instruction; ``cands`` has cand_id and the fields to search.
    """
    text = with_instruction(F.col("query"), F.col("instruction")) if instruction else F.col("query")
    q = encoder.encode(queries.select("query_id", text.alias("text")), "text")
    fields = [c for c in cands.columns if c != "cand_id"]
    c = encoder.encode(search_text(cands, fields, "text").select("cand_id", "text"), "text")
    return cosine_top_k(q.select("query_id", "vector"), c.select("cand_id", "vector"), k)


def evaluate(ranked: DataFrame, links: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Mean metrics of a ranking; ``links`` maps cand_id to the link that counts."""
    named = ranked.join(links, "cand_id").select("query_id", "rank", "link")
    return mean_metrics(ranking_metrics(named, relevant, ks))


def experiment_name(model: str, instruction: bool) -> str:
    """Folder name of an experiment."""
    safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in model).strip("_") or "model"
    return f"{safe}_{'with' if instruction else 'without'}_instruction"


def run_experiment(
    queries: DataFrame,
    cands: DataFrame,
    links: DataFrame,
    relevant: DataFrame,
    encoder: Encoder,
    path: str,
    ks: tuple = (1, 3, 5, 10),
    instruction: bool = False,
) -> dict:
    """Retrieve, evaluate and save; returns name, seconds and the saved folder."""
    began = time.time()
    name = experiment_name(encoder.name, instruction)
    # Written once: the metrics and the saved rankings both read it.
    ranked = staged(retrieve(queries, cands, encoder, max(ks), instruction), "rankings")
    scores = evaluate(ranked, links, relevant, list(ks))
    write_experiment(ranked, scores, path, name)
    return {"name": name, "seconds": time.time() - began, "path": path}
