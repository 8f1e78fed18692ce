"""The work of one batch of the feed: gate, full text, windows, votes, description gate, links, pick, ledger record."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.config import FeedConfig, LinkConfig, WindowConfig
from paperlode.functions.text import split_sentences
from paperlode.hooks import clue_probability, score_papers
from paperlode.operators.filters import gate
from paperlode.operators.links import extract_links, link_windows
from paperlode.plans.curation import label_sentences, stage_records
from paperlode.plans.link_ranking import ledger_records
from paperlode.session import staged
from paperlode.sources.markup import tei_sections

#: What a batch makes of an entry: done, no full text yet, below the gate.
OK, FAILED, FILTERED = "ok", "failed", "filtered"


def items_of_texts(texts: DataFrame) -> DataFrame:
    """Corpus items of tagged full texts (id, tei): sections in order, their sentences without labels."""
    sections = texts.select(F.col("id").alias("paper_name"), F.posexplode(tei_sections(F.col("tei"))).alias("paragraph_id", "s"))
    # A running number in front keeps the sections of a paper in the order of its text.
    section = F.format_string("%06d %s", "paragraph_id", F.coalesce("s.section", F.lit("")))
    sentence = F.transform(
        split_sentences(F.col("s.full_text")), lambda t, i: F.struct(i.cast("int").alias("sentence_id"), t.alias("text"), F.lit(0).alias("label"))
    )
    return sections.select("paper_name", section.alias("section"), "paragraph_id", sentence.alias("sentences"))


def paper_work(
    texts: Callable[[SparkSession], DataFrame],
    sources: Callable[[SparkSession], DataFrame],
    timestamp: Column,
    cfg: FeedConfig = FeedConfig(),
    scorer: Callable[[Column], Column] = clue_probability,
    windows: WindowConfig = WindowConfig(),
    links: LinkConfig = LinkConfig(),
) -> Callable[[DataFrame], DataFrame]:
    """Work for the intake, over entries (id, category, updated, title, abstract, pdf_link).

    ``texts`` and ``sources`` give what has landed by the time of a batch: tagged full texts (id, tei; one is taken per id)
    and source files (paper_id, path, text). Only papers that passed the step before are read. Every entry comes back
    with its status, its stage record (gate_prob, description, described) and, where a primary dataset link was
    found, the ledger fields. An accepted paper without a text fails and is tried again with the look-back.
    """

    def work(fresh: DataFrame) -> DataFrame:
        spark = fresh.sparkSession
        scored = staged(score_papers(fresh, scorer), "scored")
        accepted = gate(scored, cfg.gate_threshold)
        landed = texts(spark).join(accepted.select("id"), "id", "left_semi").filter("tei IS NOT NULL").dropDuplicates(["id"])
        landed = staged(landed, "texts")
        labelled = label_sentences(items_of_texts(landed), scorer, windows)
        # Title and abstract come back from the scored entries; the records go without them.
        ready = accepted.select("id", "pdf_link", "gate_prob").join(landed.select("id"), "id", "left_semi")
        records = stage_records(ready, labelled, cfg.gate_threshold, cfg.min_description_chars)
        records = staged(records.select("id", "pdf_link", "dataset_description", "desc_gate"), "records")

        described = records.filter("desc_gate.accepted")
        keys = described.select(F.col("id").alias("paper_id"), F.col("pdf_link").alias("paper_link_pdf"), "dataset_description")
        files = sources(spark).join(keys.select("paper_id"), "paper_id", "left_semi")
        found = staged(link_windows(extract_links(files, window=links.probe_sentences), links), "links")
        written = ledger_records(keys, found, ["form", "path", "pos"], timestamp, cfg=links)

        told = records.select("id", F.col("dataset_description").alias("description"), F.col("desc_gate.accepted").alias("described"))
        # Records find their entries by their links first, without descriptions; then all that is joined to the entries is dealt by id.
        named = scored.select("id", "pdf_link").join(written.withColumn("pdf_link", F.col("Paper Link")), "pdf_link").drop("pdf_link")
        rows = scored.join(told, "id", "left").join(named, "id", "left")
        status = F.when(F.col("gate_prob") >= cfg.gate_threshold, F.when(F.col("described").isNotNull(), OK).otherwise(FAILED)).otherwise(FILTERED)
        return rows.withColumn("status", status)

    return work
