"""The feed with its whole work, every batch worked on twice, gives the same as the SQL of the batch form."""

import pytest
from pyspark.sql import functions as F

from oracle import compare, duck
from paperlode.config import FeedConfig
from paperlode.plans import feed
from paperlode.queries import base, jobs
from paperlode.streaming import intake

SF = "/root/testdata/sf0.001"


def test_repeated_batches(spark, tmp_path, monkeypatch):
    run = jobs.run_feed
    monkeypatch.setattr(jobs, "run_feed", lambda s, sf, root: run(s, sf, str(tmp_path / "feed"), repeat=True))
    assert compare(spark, duck(SF), "t01_pipeline", jobs.t01_pipeline, base.ORACLES["t01_pipeline"], SF) == ""
    tables = intake.StateTables(str(tmp_path / "feed") + "/state")
    # Ledger, stage records and seen ids moved together.
    records = intake.results(spark, tables).filter(F.col("Dataset Link").isNotNull())
    assert intake.ledger(spark, tables).count() == records.select("Paper Link", "Dataset Link").distinct().count() > 0
    assert intake.seen(spark, tables).count() == intake.results(spark, tables).filter("described IS NOT NULL").count()


@pytest.mark.parametrize("least, described", [(1, [True, True]), (60, [False, True])])
def test_parameters_are_used(spark, least, described):
    rows = [("a", "We release new data. It is the dataset. The data is open."), ("b", "The dataset is new here. " * 4), ("c", "Nothing. At. All.")]
    papers = spark.createDataFrame([(i, "cs", "2024-01-01", "dataset", "data", f"p{i}") for i, _ in rows], "id string, category string, u string, title string, abstract string, pdf_link string")
    papers = papers.withColumn("updated", F.col("u").cast("timestamp"))
    tei = spark.createDataFrame([(i, f"<TEI><div><p>{t}</p></div></TEI>") for i, t in rows[:2]], "id string, tei string")
    sources = spark.createDataFrame([("b", "m.tex", r"Text. See \href{https://zenodo.org/record/1}{our dataset}. End.")], "paper_id string, path string, text string")
    cfg = FeedConfig(gate_threshold=0.0, min_description_chars=least)
    scorer = lambda c: c.contains("data").cast("double")
    got = {r["id"]: r for r in feed.paper_work(lambda s: tei, lambda s: sources, F.lit("now"), cfg, scorer)(papers).collect()}
    assert [got[i]["described"] for i in "ab"] == described and got["c"]["status"] == feed.FAILED
    assert got["b"]["Dataset Link"] == "https://zenodo.org/record/1" and got["a"]["Dataset Link"] is None
    high = FeedConfig(gate_threshold=2.0)
    assert {r["status"] for r in feed.paper_work(lambda s: tei, lambda s: sources, F.lit("now"), high, scorer)(papers).collect()} == {feed.FILTERED}


def test_records_are_staged_without_titles_and_abstracts(spark, monkeypatch):
    """Only what later steps read is written between the steps; the landed papers are written by their landing alone."""
    from paperlode.plans import curation, feed

    written: dict[str, set] = {}
    held = feed.staged

    def keep(df, name):
        written.setdefault(name, set()).update(df.columns)
        return held(df, name)

    for module in (curation, feed, jobs):
        monkeypatch.setattr(module, "staged", keep)
    assert jobs.curate_strict(spark, SF).count() > 0
    assert jobs.t01_pipeline(spark, SF).count() > 0
    assert "papers" not in written
    for name in ("accepted", "described", "records"):
        assert written[name] and not written[name] & {"title", "abstract"}
