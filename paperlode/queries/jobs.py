"""Queries of the streaming intake (T) and the extension points (X)."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode import hooks
from paperlode.config import FeedConfig, LinkConfig, WindowConfig
from paperlode.functions import responses
from paperlode.functions.text import split_sentences
from paperlode.operators import quality, retrieval, splits
from paperlode.operators.filters import category_rank, one_owner
from paperlode.operators.links import keep_listed
from paperlode.plans import curation, feed
from paperlode.plans import retrieval as experiments
from paperlode.queries.base import (
    S_DOCUMENT_SENTENCES,
    S_PAGE_LINKS,
    document_sentences,
    page_links,
    page_sources,
    query,
    s_array,
    s_sentences,
    s_squeeze,
    s_strip,
    table,
)
from paperlode.queries.functions import S_IS_DATASET, s_looks_like_code
from paperlode.queries.rows import PDF, S_CANDIDATES, S_METRICS, S_TOP10, _truth, _vectors, s_picks
from paperlode.session import new_work_dir, staged
from paperlode.sources.sinks import read_experiment
from paperlode.streaming import intake

# --- T: streaming ------------------------------------------------------------------------------

FEED_CATEGORIES = ("purchase", "signup", "view", "click", "error")
LANDINGS = 4
ENTRY = "id STRING, category STRING, updated TIMESTAMP, event_id LONG, user_id LONG, value DOUBLE, landing INT"


def _entries(spark, sf) -> DataFrame:
    """Events as feed entries; each landing holds its own quarter of the month and, as look-back, the one before."""
    e = table(spark, sf, "events")
    quarter = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(LANDINGS - 1)).cast("int")
    day = F.date_format("ts", "dd")
    rows = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("id"), F.col("event_type").alias("category"),
        F.col("ts").cast("timestamp").alias("updated"), "event_id", "user_id", "value", quarter.alias("q"),
    )
    landings = F.filter(F.array("q", F.col("q") + 1), lambda x: x < LANDINGS)
    return rows.withColumn("landing", F.explode(landings)).drop("q")


def _work(rows: DataFrame) -> DataFrame:
    """Work of the example: some users fail in some landings."""
    failed = (F.col("user_id") + F.col("landing")) % 5 == 0
    user = F.col("user_id").cast("string")
    return rows.withColumns({
        "status": F.when(failed, "failed").otherwise("ok"),
        "Paper Link": F.concat(F.lit(PDF), user, F.lit(".pdf")),
        "Dataset Link": F.concat(F.lit("https://x.org/"), F.col("category"), F.lit("/")),
        "Dataset Description": F.concat(F.lit("value "), F.floor("value").cast("string")),
        "Timestamp": F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss"),
    })


#: A landing reaches back over the quarter before it: less than 16 days.
_CFG = FeedConfig(categories=FEED_CATEGORIES, look_back_days=16)
_done: dict[tuple[str, str], intake.StateTables] = {}


def _run(spark, sf) -> intake.StateTables:
    """Land the entries part by part and let the stream take each part; once per session and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _done:
        root = new_work_dir(spark, "intake")
        tables = intake.create_state(spark, root)
        for _ in _land(spark, sf, root):
            stream = intake.read_stream(spark, root + "/landing", ENTRY)
            intake.start(stream, tables, _work, _CFG, order=("event_id",), available_now=True).awaitTermination()
        _done[key] = tables
    return _done[key]


def _land(spark, sf, root: str) -> Iterator[int]:
    """Write one landing after the other."""
    entries = _entries(spark, sf)
    for i in range(LANDINGS):
        entries.filter(F.col("landing") == i).write.mode("append").parquet(root + "/landing")
        yield i


S_INTAKE = f"""
quarters AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%d') AS id, event_type AS category, ts AS updated, event_id, user_id, value, least((day(ts) - 1) // 8, {LANDINGS - 1}) AS q FROM events),
landed AS (SELECT *, q AS landing FROM quarters UNION ALL SELECT *, q + 1 FROM quarters WHERE q + 1 < {LANDINGS}),
owned AS (SELECT * FROM landed QUALIFY row_number() OVER (PARTITION BY landing, id ORDER BY list_position({s_array(list(FEED_CATEGORIES))}, category), event_id) = 1),
tried AS (SELECT *, CASE WHEN (user_id + landing) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM owned),
first_ok AS (SELECT id, min(landing) AS won FROM tried WHERE status = 'ok' GROUP BY id),
processed AS (SELECT t.* FROM tried t LEFT JOIN first_ok f USING (id) WHERE won IS NULL OR landing <= won),
seen AS (SELECT * FROM processed WHERE status = 'ok')"""


@query("t01_polling", f"WITH {S_INTAKE} SELECT CAST(landing AS BIGINT) AS batch_id, category, status, count(*) AS n FROM processed GROUP BY 1, 2, 3")
def t01(spark, sf):
    rows = intake.results(spark, _run(spark, sf)).filter("batch_id >= 0")
    return rows.groupBy("batch_id", "category", "status").agg(F.count(F.lit(1)).alias("n"))


@query("t02_seen_ids", f"WITH {S_INTAKE} SELECT id, category FROM seen")
def t02(spark, sf):
    return intake.seen(spark, _run(spark, sf)).select("id", "category")


@query("t03_one_owner", f"""WITH {S_INTAKE} SELECT id, category, event_id FROM quarters
QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_position({s_array(list(FEED_CATEGORIES))}, category), event_id) = 1""")
def t03(spark, sf):
    rows = _entries(spark, sf)
    return one_owner(rows, category_rank(F.col("category"), list(FEED_CATEGORIES)), ["event_id"]).select("id", "category", "event_id")


@query("t04_look_back_repeats", f"WITH {S_INTAKE} SELECT DISTINCT id FROM quarters")
def t04(spark, sf):
    """Repeats of the look-back removed by the bounded state of the stream."""
    root = new_work_dir(spark, "repeats")
    for _ in _land(spark, sf, root):
        unique = intake.without_late_repeats(intake.read_stream(spark, root + "/landing", ENTRY), 40)
        writer = unique.select("id", "updated").writeStream.format("parquet").option("path", root + "/out")
        writer.option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id STRING").parquet(root + "/out")


@query("t05_progress", f"WITH {S_INTAKE} SELECT category, strftime(max(updated), '%Y-%m-%d %H:%M:%S') AS last_updated FROM seen GROUP BY category")
def t05(spark, sf):
    return intake.progress(spark, _run(spark, sf)).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


@query("t06_daily_upsert", f"""WITH {S_INTAKE}
SELECT strftime(updated, '%Y-%m-%d') AS ledger_day, '{PDF}' || user_id || '.pdf' AS "Paper Link", 'https://x.org/' || category || '/' AS "Dataset Link", count(*) AS n FROM seen GROUP BY 1, 2, 3""")
def t06(spark, sf):
    found = intake.ledger(spark, _run(spark, sf))
    return found.groupBy("ledger_day", "`Paper Link`", "`Dataset Link`").agg(F.count(F.lit(1)).alias("n"))


@query("t07_retry", f"WITH {S_INTAKE}, a AS (SELECT id, count(*) AS attempts, count(*) FILTER (status = 'ok') AS succeeded FROM processed GROUP BY id) SELECT id, attempts, succeeded FROM a WHERE attempts > 1 OR succeeded = 0")
def t07(spark, sf):
    rows = intake.results(spark, _run(spark, sf)).filter("batch_id >= 0")
    tried = rows.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "ok").alias("succeeded"))
    return tried.filter("attempts > 1 or succeeded = 0")


@query("t08_stop", "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def t08(spark, sf):
    """A polling query that stops on request once everything landed has been read."""
    root = new_work_dir(spark, "stop")
    e = table(spark, sf, "events").select(F.col("event_type").alias("category"), "event_id")
    e.write.parquet(root + "/landing")
    stream = intake.read_stream(spark, root + "/landing", "category STRING, event_id LONG", files=8)
    writer = stream.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/checkpoint")
    running = writer.trigger(processingTime="1 second").start()
    running.processAllAvailable()
    intake.run_until(running, lambda: True)
    return spark.read.schema("category STRING").parquet(root + "/out").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# --- X: extension points -----------------------------------------------------------------------


def s_clue(e: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({e}), '{c}') AS INTEGER)" for c in CLUES)
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-(-1.0::DOUBLE + {hits})))"


CLUES = ["tion", "that", "elle", "ung", "ado", "the"]


def _scorer(c):
    return hooks.clue_probability(c, CLUES)


@query("x01_gate_score", f"""SELECT doc_id, round({s_clue("source || ' ' || text")}, 6) AS gate_prob FROM documents""")
def x01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"))
    return hooks.score_papers(d, _scorer).select("doc_id", F.round("gate_prob", 6).alias("gate_prob"))


@query("x01_batch_scorer", "SELECT item_id, round(length(text) / 1000.0::DOUBLE, 6) AS gate_prob FROM benchmark")
def x01_batch(spark, sf):
    """Any batch model as a scorer, called on slices of Arrow batches."""
    scorer = hooks.batch_scorer(lambda texts: [len(t) / 1000 for t in texts], batch=7)
    return table(spark, sf, "benchmark").select("item_id", F.round(scorer(F.col("text")), 6).alias("gate_prob"))


@query("x02_gate_training")
def x02(spark, sf):
    """Train on the labelled documents, score the held-out part."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    parts = splits.stratified_split(d.select("doc_id", "text", F.col("quality").alias("label")), "label", "doc_id")
    model = hooks.train_gate(parts.filter("part = 'train'"), 1 << 12, 10)
    scored = hooks.apply_gate(model, parts.filter("part = 'eval'"))
    return quality.binary_metrics(scored.withColumnRenamed("label", "true_label"))


@query("x03_tag_windows", f"""WITH {S_DOCUMENT_SENTENCES}, near AS (SELECT paper_name, gid, text, unnest(range(greatest(0, gid - 2), gid + 1)) AS window_id FROM doc_sents)
SELECT paper_name, window_id, gid, round({s_clue('text')}, 6) AS prob, CAST({s_clue('text')} >= 0.5 AS INTEGER) AS label FROM near""")
def x03(spark, sf):
    rows = document_sentences(spark, sf)
    members = rows.withColumn("window_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("gid") - 2), F.col("gid"))))
    return hooks.tag_windows(members, _scorer).select("paper_name", "window_id", "gid", F.round("prob", 6).alias("prob"), "label")


@query("x03_label_sentences", f"""WITH {S_DOCUMENT_SENTENCES} SELECT paper_name, gid,
  CAST(count(*) OVER (PARTITION BY paper_name) >= 3 AND {s_clue('text')} >= 0.5 AS INTEGER) AS label FROM doc_sents""")
def x03_label(spark, sf):
    """Windows, tagger and vote: a scorer that sees one sentence gives it the same label in every window.

    Papers below the minimum of three sentences have no window and keep label 0.
    """
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_name"), F.lit("").alias("section"), F.lit(0).alias("paragraph_id"), "text"
    )
    sentence = F.transform(split_sentences(F.col("text")), lambda t, i: F.struct(i.alias("sentence_id"), t.alias("text"), F.lit(0).alias("label")))
    labelled = curation.label_sentences(items.select("paper_name", "section", "paragraph_id", sentence.alias("sentences")), _scorer)
    return labelled.select("paper_name", "gid", "label")


@query("x04_encode")
def x04(spark, sf):
    """Hashed unit vectors of all texts; the hash is Spark's own."""
    rows = hooks.HashingEncoder(64).encode(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("vector").alias("size"), F.md5(F.array_join(F.col("vector").cast("array<string>"), ",")).alias("digest"))


@query("x05_retriever", f"WITH {S_TOP10} SELECT query_id, cand_id, CAST(rank AS INTEGER) AS rank FROM top10 WHERE rank <= 3")
def x05(spark, sf):
    """A retriever made by name from the stored vectors."""
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("vec_id").cast("string").alias("query"), F.lit("").alias("instruction"))
    given = hooks.make_encoder("given", e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    q = given.encode(queries, "query")
    c = hooks.make_encoder("given", _vectors(spark, sf, "cand_id"), "cand_id").encode(e.select(F.col("vec_id").alias("cand_id")), "text")
    return retrieval.cosine_top_k(q.select("query_id", "vector"), c, 3).select("query_id", "cand_id", "rank")


@query("x06_count_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS INTEGER) AS tokens FROM documents")
def x06(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hooks.token_column(F.col("text")).alias("tokens"))


@query("x07_requests", f"WITH {S_PAGE_LINKS} SELECT paper_id, CAST(pos // 4 AS BIGINT) AS batch_id, CAST(pos % 4 AS INTEGER) AS idx, url FROM page_links")
def x07(spark, sf):
    return hooks.request_table(page_links(spark, sf), ["paper_id"], "pos").select("paper_id", "batch_id", "idx", "url")


@query("x07_pick_answers", f"""WITH {S_PAGE_LINKS} SELECT paper_id, url, 'link ' || pos AS reason, CAST(pos % 10 AS DOUBLE) / 10 AS confidence FROM page_links
  WHERE contains(anchor, 'dataset') AND pos % 2 = 0""")
def x07_picks(spark, sf):
    """Answers of a picker inside prose, read, and kept if they name a candidate as it is spelled; odd ones name another url."""
    rows = page_links(spark, sf)
    url = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" "), "url")).otherwise(F.concat(F.lit("https://none.example/"), F.col("pos").cast("string")))
    primary = F.struct(url.alias("url"), F.concat(F.lit("link "), F.col("pos").cast("string")).alias("reason"), (F.col("pos") % 10 / 10.0).alias("confidence"))
    answer = F.concat(F.lit("My choice:\n"), F.to_json(F.struct(primary.alias("primary"))), F.lit("\nAs asked."))
    answers = rows.filter(F.col("anchor").contains("dataset")).select("paper_id", answer.alias("answer"))
    picks = answers.withColumn("pick", responses.parse_pick(F.col("answer"))).select("paper_id", "pick.*")
    return keep_listed(picks, rows, normalised=False)


@query("x08_experiment")
def x08(spark, sf):
    """Benchmark texts as queries over all documents, encoded by hashing; a passage is found in its document."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("").alias("instruction"))
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("cand_id"), "text")
    return experiments.retrieve(b, c, hooks.HashingEncoder(128), 10).withColumn("score", F.round("score", 6))


S_MEAN_METRICS = f"""WITH {S_METRICS}, l AS (UNPIVOT (SELECT * FROM m) ON {', '.join(retrieval.METRICS)} INTO NAME metric VALUE value)
SELECT metric, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS num_valid_queries FROM l GROUP BY 1, 2"""


@query("x08_given_vectors", S_MEAN_METRICS)
def x08_given(spark, sf):
    """The whole experiment on stored vectors, read back from its saved scores."""
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), F.lit("q").alias("query"), F.lit("").alias("instruction"))
    ranked = retrieval.cosine_top_k(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 10)
    links = e.select(F.col("vec_id").alias("cand_id"), F.col("vec_id").alias("link"))
    scores = experiments.evaluate(ranked.join(queries.select("query_id"), "query_id"), links, _truth(spark, sf), [1, 3, 5, 10])
    return scores.select("metric", "k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "num_valid_queries")


@query("x08_saved_experiment", S_MEAN_METRICS)
def x08_saved(spark, sf):
    """One call of the whole experiment: vectors by text, search, metrics, saved rankings and scores, read back."""
    e = table(spark, sf, "embeddings")
    name = F.col("vec_id").cast("string")
    queries = e.select(F.col("vec_id").alias("query_id"), name.alias("query"), F.lit("").alias("instruction"))
    cands = e.select(F.col("vec_id").alias("cand_id"), name.alias("vec"))
    forms = F.explode(F.array(name, F.concat(F.lit("vec: "), name)))
    given = hooks.make_encoder("given", e.select(forms.alias("text"), F.col("embedding").alias("vector")), "text")
    links = e.select(F.col("vec_id").alias("cand_id"), F.col("vec_id").alias("link"))
    done = experiments.run_experiment(queries, cands, links, _truth(spark, sf), given, new_work_dir(spark, "experiment"))
    scores = read_experiment(spark, done["path"], "score", "metric STRING, k INT, mean DOUBLE, std DOUBLE, num_valid_queries BIGINT")
    saved = scores.filter(F.col("experiment") == done["name"])
    return saved.select("metric", "k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "num_valid_queries")


def _curated(spark, sf, links: LinkConfig) -> DataFrame:
    d = table(spark, sf, "documents")
    entries = d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("abstract"),
        F.concat(F.lit(PDF), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("pdf_link"),
    )
    items = d.select(
        F.col("doc_id").cast("string").alias("paper_name"), F.col("lang").alias("section"), F.lit(0).alias("paragraph_id"), "text"
    )
    sentence = F.transform(split_sentences(F.col("text")), lambda t, i: F.struct(i.alias("sentence_id"), t.alias("text"), F.lit(0).alias("label")))
    return curation.curate(
        entries, items.select("paper_name", "section", "paragraph_id", sentence.alias("sentences")), _sources(spark, sf), F.lit("now"), _scorer,
        WindowConfig(), links,
    )


def _sources(spark, sf) -> DataFrame:
    """Pages as the source files of the papers of the same number."""
    return page_sources(spark, sf).withColumn("paper_id", F.col("paper_id").cast("string"))


def s_described(sentences: str, least: int) -> str:
    """Papers with an accepted description: a paper of three sentences or more has windows, and each gets its own label."""
    return f"""
labelled AS (SELECT paper_name, gid, {s_strip('text')} AS text, count(*) OVER (PARTITION BY paper_name) >= 3 AND {s_clue('text')} >= 0.5 AS yes FROM {sentences}),
described AS (SELECT paper_name, coalesce(string_agg(text, ' ' ORDER BY gid) FILTER (yes AND text <> ''), '') AS description FROM labelled GROUP BY 1),
accepted AS (SELECT * FROM described WHERE length(description) >= {least})"""


S_PRIMARY = f"""{S_CANDIDATES}, {s_picks('cands')},
primary_links AS (
  SELECT l.paper_id, coalesce(p.url, r.url, l.url) AS url, coalesce(p.anchor, r.anchor, l.anchor) AS why, coalesce(p.norm_url, r.norm_url, l.norm_url) AS norm_url,
         coalesce(p.host_path, r.host_path, l.host_path) AS host_path
  FROM leader l LEFT JOIN preferred p USING (paper_id) LEFT JOIN ruled r USING (paper_id)),
dataset_links AS (SELECT *, {s_squeeze('why')} AS said FROM primary_links WHERE {S_IS_DATASET})"""


@query("curate_batch")
def curate(spark, sf):
    """The batch pipeline end to end: gate, windows, votes, descriptions, links and ledger records."""
    return _curated(spark, sf, LinkConfig())


@query("curate_batch_strict", f"""WITH {S_DOCUMENT_SENTENCES}, {s_described('doc_sents', 1)}, {S_PRIMARY},
gated AS (SELECT doc_id FROM documents WHERE {s_clue("source || ' ' || text")} >= 0.5)
SELECT '{PDF}' || paper_id || '.pdf' AS "Paper Link", url AS "Dataset Link", said AS "Dataset Description", 'now' AS "Timestamp"
FROM dataset_links JOIN accepted ON paper_id = paper_name JOIN gated ON paper_id = doc_id WHERE said <> '' AND NOT {s_looks_like_code('said')}""")
def curate_strict(spark, sf):
    """The same with descriptions of the picks alone, so that SQL can follow it to the last column."""
    return _curated(spark, sf, LinkConfig(strict=True))


# --- the feed with its whole work --------------------------------------------------------------

_FEED = FeedConfig(categories=("en", "de", "es", "fr"), gate_threshold=0.6, look_back_days=10, min_description_chars=40)
_PAPER = "id STRING, category STRING, updated TIMESTAMP, title STRING, abstract STRING, pdf_link STRING, landing INT"


def _feed_papers(spark, sf) -> DataFrame:
    """Documents as papers: twenty days in four landings; a landing offers the papers of the one before again.

    The full text of every fifth paper lands one landing late.
    """
    day = F.pmod("doc_id", F.lit(20)).cast("int")
    q = F.floor(day / 5).cast("int")
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("updated"),
        F.col("source").alias("title"), F.col("text").alias("abstract"), F.concat(F.lit(PDF), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("pdf_link"),
        q.alias("q"), F.when(F.col("doc_id") % 5 == 0, q + 1).otherwise(q).alias("lands"),
    )


def run_feed(spark, sf, root: str, repeat: bool = False) -> intake.StateTables:
    """Land papers and texts part by part and let the stream work on each part; ``repeat`` works on every batch twice."""
    papers = _feed_papers(spark, sf)
    body = F.regexp_replace("abstract", "[<>&]", "")
    tei = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><div><head>All</head><p>'), body, F.lit("</p></div></text></TEI>"))
    sources = staged(_sources(spark, sf), "sources")

    def texts(session):
        return session.read.schema("id STRING, tei STRING").parquet(root + "/texts")

    work = feed.paper_work(texts, lambda _: sources, F.lit("now"), _FEED, _scorer)
    tables = intake.create_state(spark, root + "/state")

    def cycle(batch, batch_id):
        for _ in range(2 if repeat else 1):
            intake.process_batch(batch, batch_id, tables, work, _FEED, ("id",))

    for i in range(LANDINGS):
        papers.filter(F.col("lands") == i).select("id", tei.alias("tei")).write.mode("append").parquet(root + "/texts")
        offered = papers.filter(F.col("q").isin(i - 1, i)).drop("q", "lands")
        offered.withColumn("landing", F.lit(i)).write.mode("append").parquet(root + "/landing")
        stream = intake.read_stream(spark, root + "/landing", _PAPER).writeStream.foreachBatch(cycle)
        stream.option("checkpointLocation", tables.checkpoint).trigger(availableNow=True).start().awaitTermination()
    return tables


@query("t01_pipeline", f"""WITH tei_sents AS (
  SELECT doc_id AS paper_name, unnest(s) AS text, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS gid
  FROM (SELECT doc_id, {s_sentences("regexp_replace(text, '[<>&]', '', 'g')")} AS s FROM documents)), {s_described('tei_sents', 40)}, {S_PRIMARY},
fed AS (
  SELECT doc_id, lang AS category, doc_id % 20 // 5 AS q, doc_id % 20 // 5 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS lands, {s_clue("source || ' ' || text")} AS prob FROM documents),
offered AS (SELECT *, q AS landing FROM fed UNION ALL SELECT *, q + 1 FROM fed WHERE q + 1 < {LANDINGS}),
tried AS (SELECT *, CASE WHEN prob < 0.6 THEN 'filtered' WHEN lands <= landing THEN 'ok' ELSE 'failed' END AS status FROM offered),
done AS (SELECT *, min(CASE WHEN status = 'ok' THEN landing END) OVER (PARTITION BY doc_id) AS won FROM tried),
worked AS (SELECT * FROM done WHERE won IS NULL OR landing <= won)
SELECT CAST(landing AS BIGINT) AS batch_id, CAST(doc_id AS VARCHAR) AS id, category, status, round(prob, 6) AS gate_prob,
       CASE WHEN status = 'ok' THEN md5(coalesce(d.description, '')) END AS description, CASE WHEN status = 'ok' THEN a.paper_name IS NOT NULL END AS described,
       CASE WHEN status = 'ok' AND a.paper_name IS NOT NULL THEN k.url END AS dataset_link
FROM worked LEFT JOIN described AS d ON d.paper_name = doc_id LEFT JOIN accepted AS a ON a.paper_name = doc_id LEFT JOIN dataset_links AS k ON k.paper_id = doc_id""")
def t01_pipeline(spark, sf):
    """What the feed has done with every paper in every batch, by its whole work."""
    rows = intake.results(spark, run_feed(spark, sf, new_work_dir(spark, "feed"))).filter("batch_id >= 0")
    return rows.select(
        "batch_id", "id", "category", "status", F.round("gate_prob", 6).alias("gate_prob"), F.md5("description").alias("description"), "described",
        F.col("Dataset Link").alias("dataset_link"),
    )
