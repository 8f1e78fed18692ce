"""Batch form of the pipeline: papers and full texts in, descriptions and ledger records out."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.config import LinkConfig, WindowConfig
from paperlode.functions.text import count_tokens
from paperlode.hooks import clue_probability, score_papers, tag_whole_windows, tag_windows
from paperlode.operators.filters import gate
from paperlode.operators.links import extract_links, link_windows
from paperlode.operators.sentences import (
    apply_predictions,
    collect_description,
    description_gate,
    global_sentence_ids,
)
from paperlode.operators.windows import any_vote, mean_vote, token_windows, window_members
from paperlode.plans.link_ranking import ledger_records
from paperlode.session import staged


def accepted_papers(papers: DataFrame, scorer: Callable[[Column], Column] = clue_probability, threshold: float = 0.5) -> DataFrame:
    """Papers whose title and abstract pass the gate; the cheap filter runs before anything else."""
    return gate(score_papers(papers, scorer), threshold)


def label_sentences(
    items: DataFrame,
    scorer: Callable[[Column], Column] = clue_probability,
    cfg: WindowConfig = WindowConfig(),
    vote: str = "any",
    threshold: float = 0.5,
    whole_windows: bool = False,
) -> DataFrame:
    """Corpus items to labelled sentences through token windows and a vote.

    The numbered sentences feed the windows, their members and the write-back, so they are staged. With
    ``whole_windows`` the scorer gets the array of a window's sentences and gives one probability each. For the
    mean vote a paper below the minimum of a window is one window; the any-vote leaves it unlabelled.
    """
    numbered = global_sentence_ids(items).withColumn("tokens", count_tokens(F.col("text")))
    tokens = staged(numbered, "sentences")
    longest = tokens.agg(F.max("gid")).first()[0] or 0
    windows = token_windows(tokens, cfg, max_index=longest).select("paper_name", "window_id", "first", "last")
    if vote == "mean":
        spans = tokens.groupBy("paper_name").agg(F.max("gid").alias("last")).filter(F.col("last") + 1 < cfg.min_sentences)
        zero = F.lit(0).cast("long")
        windows = windows.unionByName(spans.select("paper_name", zero.alias("window_id"), zero.alias("first"), "last"))
    rows = tokens.drop("tokens")
    members, texts = window_members(windows), rows.select("paper_name", "gid", "text")
    if whole_windows:
        tagged = tag_whole_windows(members.join(texts, ["paper_name", "gid"]), scorer, threshold)
    else:
        # A sentence has the same probability in all its windows: it is scored where it lies, and its text does not travel.
        tagged = members.join(tag_windows(texts, scorer, threshold).drop("text"), ["paper_name", "gid"])
    if vote == "mean":
        return mean_vote(tagged, rows.drop("label"), threshold)
    return apply_predictions(rows, any_vote(tagged), ["paper_name", "gid"])


def stage_records(papers: DataFrame, labelled: DataFrame, threshold: float = 0.5, min_chars: int = 1) -> DataFrame:
    """Stage records with description and both gates; papers without a text get an empty description."""
    described = collect_description(labelled, ["paper_name"], ["gid"]).withColumnRenamed("paper_name", "id")
    rows = papers.join(described, "id", "left").withColumn(
        "dataset_description", F.coalesce("description", F.lit(""))
    ).drop("description")
    return description_gate(rows, threshold, min_chars)


def curate(
    papers: DataFrame,
    items: DataFrame,
    sources: DataFrame,
    timestamp: Column,
    scorer: Callable[[Column], Column] = clue_probability,
    windows: WindowConfig = WindowConfig(),
    links: LinkConfig = LinkConfig(),
) -> DataFrame:
    """Ledger records of a batch: gate, label, describe, extract links, pick.

    ``papers`` has id, title, abstract, pdf_link; ``items`` are corpus items whose paper_name is the
    id; ``sources`` has paper_id, path and text. Each step keeps only papers that passed the one before.
    """
    # Titles and abstracts are read by the gate only; what is staged, joined and staged again goes without them.
    kept = staged(accepted_papers(papers, scorer).select("id", "pdf_link", "gate_prob"), "accepted")
    wanted = items.join(kept.select(F.col("id").alias("paper_name")), "paper_name", "left_semi")
    labelled = label_sentences(wanted, scorer, windows)
    records = stage_records(kept, labelled).filter("desc_gate.accepted")
    keys = records.select(
        F.col("id").alias("paper_id"), F.col("pdf_link").alias("paper_link_pdf"), "dataset_description"
    )
    keys = staged(keys, "described")
    files = sources.join(keys.select("paper_id"), "paper_id", "left_semi")
    found = link_windows(extract_links(files, window=links.probe_sentences), links)
    return ledger_records(keys, staged(found, "links"), ["form", "path", "pos"], timestamp, cfg=links)
