"""Queries of the joins (J), aggregates (A), windows (W), sorts (O) and set operations (U)."""

from pyspark.sql import functions as F

from paperlode import hooks, rules
from paperlode.config import LinkConfig, PackConfig, WindowConfig
from paperlode.functions import urls
from paperlode.functions.dates import year_of
from paperlode.functions.text import LABEL_REQUEST, count_tokens, has_latex, split_sentences
from paperlode.operators import filters, ledger, links, postings, quality, retrieval, sentences, splits, statistics, windows
from paperlode.operators.ranks import top_rows
from paperlode.plans.consolidation import consolidate
from paperlode.plans.link_ranking import primary_links
from paperlode.queries.base import (
    S_DOCUMENT_SENTENCES,
    S_PAGE_LINKS,
    S_PAGE_SOURCES,
    S_PAPERS,
    S_PREDICTIONS,
    S_SENTENCES,
    corpus_items,
    document_sentences,
    page_links,
    page_sources,
    pages_with_links,
    papers,
    predictions,
    query,
    s_any,
    s_array,
    s_sentences,
    s_strip,
    table,
)
from paperlode.queries.functions import (
    S_KEYED,
    S_LATEX_TEST,
    S_SCORED,
    s_host_path,
    s_latex,
    s_latex_kept,
    s_norm,
    s_score,
)
from paperlode.session import new_work_dir, staged

PDF = "https://arxiv.org/pdf/"

# --- J: joins ----------------------------------------------------------------------------------


@query("j01_unseen", """SELECT event_id, CAST(user_id AS VARCHAR) AS id FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 250)""")
def j01(spark, sf):
    e = table(spark, sf, "events").withColumn("id", F.col("user_id").cast("string"))
    return filters.unseen(e, e.filter("event_type = 'error' and value > 250")).select("event_id", "id")


@query("j02_url_of_sample", """SELECT o_orderkey AS pos, o_custkey AS "Sample", c_name AS url FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def j02(spark, sf):
    preds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("Sample"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("count"), F.col("c_name").alias("url"), F.col("c_mktsegment").alias("category"))
    return filters.url_of_sample(preds, known, "BUILDING")


@query("j03_write_back", f"""WITH {S_SENTENCES}
SELECT paper_name, gid, CAST(CASE WHEN contains(text, 'on') THEN 1 ELSE label END AS INTEGER) AS label FROM numbered""")
def j03(spark, sf):
    rows = sentences.global_sentence_ids(corpus_items(spark, sf))
    found = rows.filter(F.col("text").contains("on")).select("paper_name", "gid", F.lit(1).alias("label"))
    return sentences.apply_predictions(rows, found, ["paper_name", "gid"]).select("paper_name", "gid", "label")


@query("j04_label_map", f"""WITH {S_DOCUMENT_SENTENCES}
SELECT paper_name, gid, CAST(CASE WHEN contains(text, 'an') THEN length(text) % 2 ELSE 0 END AS INTEGER) AS label FROM doc_sents""")
def j04(spark, sf):
    rows = document_sentences(spark, sf).withColumn("label", F.lit(0))
    found = rows.filter(F.col("text").contains("an")).select("paper_name", "gid", (F.length("text") % 2).alias("label"))
    return sentences.apply_label_map(rows, found).select("paper_name", "gid", "label")


@query("j04_positional_labels", f"""WITH {S_DOCUMENT_SENTENCES}
SELECT paper_name, gid, CAST(CASE WHEN gid < 3 THEN 1 ELSE 0 END AS INTEGER) AS label FROM doc_sents""")
def j04_positional(spark, sf):
    rows = document_sentences(spark, sf).withColumn("label", F.lit(0))
    answers = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_name"), F.array(*[F.lit(1)] * 3).alias("labels"))
    return sentences.apply_positional_labels(rows, answers).select("paper_name", "gid", "label")


def _ledger_side(spark, sf, side: int):
    """Documents as ledger rows of one side: old and new rows share half of their ids, some ids repeat."""
    d = table(spark, sf, "documents")
    n = F.floor(F.col("doc_id") / 2) if side == 0 else F.floor(F.col("doc_id") / 3)
    number = F.lpad(n.cast("string"), 5, "0")
    id_ = F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("2401."), number)).otherwise(F.concat(F.lit("2401."), number, F.lit("v1")))
    blank = F.col("doc_id") % 4 == side
    return d.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit(PDF), id_, F.lit(".pdf")).alias("Paper Link"),
        F.when(F.col("doc_id") % 3 == side, " ").otherwise(F.concat(F.lit("https://zenodo.org/"), F.col("doc_id").cast("string"))).alias("Dataset Link"),
        F.when(~blank, F.col("text")).alias("Dataset Description"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("Timestamp"),
    )


def s_ledger_side(side: int) -> str:
    n = "doc_id // 2" if side == 0 else "doc_id // 3"
    number = f"lpad(CAST({n} AS VARCHAR), 5, '0')"
    return f"""SELECT doc_id AS pos, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE '2401.' || {number} || 'v1' END AS id,
  '{PDF}2401.' || {number} || CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'v1' END || '.pdf' AS p,
  CASE WHEN doc_id % 3 = {side} THEN ' ' ELSE 'https://zenodo.org/' || doc_id END AS d,
  CASE WHEN doc_id % 4 <> {side} THEN text ELSE '' END AS t, 't' || doc_id AS ts FROM documents"""


S_MERGE = f"""
old AS ({s_ledger_side(0)}), new AS ({s_ledger_side(1)}),
side AS (
  SELECT id, 0 AS k, pos, p, d, t, ts FROM old WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1
  UNION ALL SELECT id, 1, pos, p, d, t, ts FROM new WHERE id IS NOT NULL),
merged AS (
  SELECT id, coalesce(arg_min(p, k * 1000000000 + pos) FILTER (trim(p) <> ''), '') AS p, coalesce(arg_min(d, k * 1000000000 + pos) FILTER (trim(d) <> ''), '') AS d,
         coalesce(arg_min(t, k * 1000000000 + pos) FILTER ({s_strip('t')} <> ''), '') AS t, coalesce(arg_min(ts, k * 1000000000 + pos) FILTER (ts <> ''), '') AS ts
  FROM side GROUP BY id)"""


@query("j05_merge_fill", f"""WITH {S_MERGE}
SELECT p AS "Paper Link", d AS "Dataset Link", t AS "Dataset Description", ts AS "Timestamp" FROM merged
UNION ALL SELECT p, d, t, ts FROM old WHERE id IS NULL""")
def j05(spark, sf):
    return ledger.merge_fill(_ledger_side(spark, sf, 0), _ledger_side(spark, sf, 1))


@query("j05_consolidate", f"""WITH {S_MERGE}
SELECT * FROM (SELECT p AS "Paper Link", d AS "Dataset Link", t AS "Dataset Description", ts AS "Timestamp" FROM merged
UNION ALL SELECT p, d, t, ts FROM old WHERE id IS NULL) WHERE {s_strip('"Dataset Description"')} <> ''""")
def j05_consolidate(spark, sf):
    return consolidate(_ledger_side(spark, sf, 0), [_ledger_side(spark, sf, 1)])


@query("j06_keep_labelled", f"""WITH {S_PAGE_LINKS} SELECT paper_id, pos, url FROM page_links WHERE url IN (SELECT url FROM page_links WHERE contains(anchor, 'dataset'))""")
def j06(spark, sf):
    cands = page_links(spark, sf)
    labelled = cands.select("url", F.when(F.col("anchor").contains("dataset"), "dataset").otherwise("code").alias("label"))
    return links.keep_labelled(cands.drop("anchor"), labelled).select("paper_id", "pos", "url")


@query("j07_zip", f"""WITH {S_PAGE_LINKS} SELECT paper_id, pos, url, anchor, length(anchor) AS size FROM page_links""")
def j07(spark, sf):
    rows = page_links(spark, sf)
    left, right = rows.select("paper_id", "pos", "url"), rows.select("paper_id", "pos", "anchor", F.length("anchor").cast("long").alias("size"))
    return filters.zip_by_position(left, right, ["paper_id", "pos"])


S_TRUTH = """
truth AS (SELECT vec_id AS query_id, unnest(range(vec_id // 5 * 5, vec_id // 5 * 5 + 5)) AS link FROM embeddings)"""


def _truth(spark, sf):
    """Known answers of the stored vectors: the block of five ids a vector belongs to."""
    first = F.floor(F.col("vec_id") / 5) * 5
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(first, first + 4)).alias("link"))


def _vectors(spark, sf, name: str):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))


S_TOP10 = """
sims AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings c),
top10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM sims QUALIFY rank <= 10)"""


@query("j08_relevance", f"""WITH {S_TOP10}, {S_TRUTH}
SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.cand_id AS link, CAST(r.link IS NOT NULL AS INTEGER) AS hit FROM top10 t LEFT JOIN truth r ON r.query_id = t.query_id AND r.link = t.cand_id""")
def j08(spark, sf):
    ranked = retrieval.cosine_top_k(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 10)
    return retrieval.mark_hits(ranked.withColumnRenamed("cand_id", "link").drop("score"), _truth(spark, sf)).select("query_id", "rank", "link", "hit")


@query("j09_align_responses", """SELECT conv_id * 1000 + turn // 4 AS batch_id, CAST(turn % 4 AS INTEGER) AS idx, CASE WHEN turn % 2 = 0 OR turn % 4 = 3 THEN 'u' || conv_id ELSE 'w' || turn END AS url,
  CASE WHEN turn % 4 <> 3 AND turn % 3 = 0 THEN 'dataset' ELSE 'other' END AS label FROM conversations""")
def j09(spark, sf):
    """Batches of four requests; the last answer of each full batch is missing."""
    c = table(spark, sf, "conversations").withColumns({"batch_id": F.col("conv_id") * 1000 + F.floor(F.col("turn") / 4), "idx": (F.col("turn") % 4).cast("int")})
    requests = c.select("batch_id", "idx", F.concat(F.lit("u"), F.col("conv_id")).alias("url"), F.lit("no clue").alias("context"))
    item = F.struct(
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("w"), F.col("turn").cast("string"))).alias("url"),
        F.when(F.col("turn") % 3 == 0, "some data").when(F.col("turn") % 3 == 1, "none").alias("label"),
        F.lit(None).cast("string").alias("why"), F.lit(None).cast("string").alias("desc"),
    )
    answers = c.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.when(F.col("idx") < 3, F.struct("idx", item.alias("item"))))).alias("x"))
    answers = answers.select("batch_id", F.transform("x", lambda e: e["item"]).alias("items"))
    return filters.align_responses(requests, answers).select("batch_id", "idx", "url", "label")


@query("j10_section_asof", """WITH rows AS (SELECT l_orderkey AS file, l_linenumber * 10 AS pos, l_partkey, l_returnflag = 'N' AS head FROM lineitem)
SELECT a.file, a.pos, a.l_partkey AS part, coalesce((SELECT arg_max('s' || b.pos, b.pos) FROM rows b WHERE b.file = a.file AND b.head AND b.pos <= a.pos), '') AS section FROM rows a WHERE NOT a.head""")
def j10(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 10).alias("pos"), F.col("l_partkey").alias("part"), (F.col("l_returnflag") == "N").alias("head")
    )
    heads = rows.filter("head").select("file", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("section"))
    return sentences.section_asof(rows.filter("not head").select("file", "pos", "part"), heads, ["file"])


@query("j11_sentence_at", f"""WITH {S_DOCUMENT_SENTENCES}, spans AS (SELECT paper_name AS file, gid AS sid, gid * 10 AS a, gid * 10 + 8 AS b FROM doc_sents),
lst AS (SELECT file, max(sid) AS m FROM spans GROUP BY file),
pts AS (SELECT paper_name AS file, gid * 10 + length(text) % 12 AS pos, gid AS point FROM doc_sents)
SELECT p.file, p.pos, p.point, CASE WHEN s.sid IS NOT NULL THEN s.sid WHEN p.pos >= m * 10 + 8 THEN m ELSE 0 END AS sentence_index
FROM pts p JOIN lst USING (file) LEFT JOIN spans s ON s.file = p.file AND p.pos >= s.a AND p.pos < s.b""")
def j11(spark, sf):
    rows = document_sentences(spark, sf)
    start = F.col("gid") * 10
    spans = rows.select(F.col("paper_name").alias("file"), F.col("gid").alias("sid"), start.alias("span_start"), (start + 8).alias("span_end"))
    points = rows.select(F.col("paper_name").alias("file"), (start + F.length("text") % 12).alias("pos"), F.col("gid").alias("point"))
    return sentences.sentence_at(points, spans, ["file"])


@query("j11_line_number", "SELECT doc_id, CAST(length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) + 1 AS INTEGER) AS line FROM documents")
def j11_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sentences.line_number(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).alias("line"))


@query("j12_validated_picks", f"""WITH {S_KEYED}
SELECT paper_id, replace(url, 'https:', 'HTTP:') || '/' AS url FROM keyed WHERE contains(anchor, 'dataset') AND NOT contains(url, '?') AND NOT contains(url, '.zip')""")
def j12(spark, sf):
    rows = page_links(spark, sf)
    plain = ~F.col("url").contains("?") & ~F.col("url").contains(".zip")
    picks = rows.filter(F.col("anchor").contains("dataset")).select(
        "paper_id", F.when(plain, F.concat(F.replace("url", F.lit("https:"), F.lit("HTTP:")), F.lit("/"))).otherwise(F.concat(F.lit("https://none.example/"), F.col("pos").cast("string"))).alias("url")
    )
    return links.keep_listed(picks, rows).select("paper_id", "url")


@query("j13_query_by_candidate", f"""WITH {S_TOP10}
SELECT query_id, count(*) AS compared, count(*) FILTER (score >= 0.3) AS similar, round(max(score), 6) AS best FROM sims GROUP BY query_id""")
def j13(spark, sf):
    """Every query against every candidate, in block products."""
    found = retrieval.similarity_profile(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 0.3)
    return found.withColumn("best", F.round("best", 6))


@query("j14_compare_methods", f"""WITH {S_PREDICTIONS}, g AS (SELECT * FROM preds WHERE true_label <> -100),
m AS (SELECT 'half' AS method, predicted_label AS p, true_label AS g FROM g UNION ALL SELECT 'any', CAST(prob >= 0.2 AS INTEGER), true_label FROM g),
c AS (SELECT method, count(*) FILTER (p = 1 AND g = 1) AS tp, count(*) FILTER (p = 1 AND g = 0) AS fp, count(*) FILTER (p = 0 AND g = 1) AS fn FROM m GROUP BY method)
SELECT method, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def j14(spark, sf):
    p = predictions(spark, sf)

    def run(df):
        m = quality.binary_metrics(df)
        return m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("precision", "recall")])).alias("x")).select("x.*")

    other = p.withColumn("predicted_label", (F.col("prob") >= 0.2).cast("int"))
    return quality.compare_methods({"half": run(p), "any": run(other)}, ["precision", "recall"])


# --- A: aggregates -----------------------------------------------------------------------------

S_TEX_DOC = f"""tex AS (SELECT 'cs.' || lang AS category, {S_LATEX_TEST} AS hit FROM (
  SELECT lang, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'tion', '\\Alpha tion') ELSE text END AS t FROM documents))"""


def _tex_papers(spark, sf):
    body = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("tion"), F.lit("\\Alpha tion"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(F.concat(F.lit("cs."), F.col("lang")).alias("category"), body.alias("body"))


@query("a01_share_by_category", f"WITH {S_TEX_DOC} SELECT category, count(*) AS total, count(*) FILTER (hit) AS hits, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) AS percent FROM tex GROUP BY category")
def a01(spark, sf):
    return statistics.share_by_category(_tex_papers(spark, sf), has_latex(F.col("body")))


@query("a02_share_with_total", f"""WITH {S_TEX_DOC} SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS total, count(*) FILTER (hit) AS hits,
  round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) AS percent FROM tex GROUP BY ROLLUP (category)""")
def a02(spark, sf):
    return statistics.share_with_total(_tex_papers(spark, sf), has_latex(F.col("body")))


_ORDER = ["cs.en", "cs.de", "cs.fr", "cs.es"]


def _ranked_papers(spark, sf):
    return papers(spark, sf).withColumn("category_rank", filters.category_rank(F.col("category"), _ORDER))


S_RANKED = S_PAPERS + f""",
ranked AS (SELECT *, coalesce(list_position({s_array(_ORDER)}, category), {len(_ORDER) + 1}) AS category_rank FROM papers)"""


@query("a03_yearly_counts", f"""WITH {S_RANKED}, yearly AS (
  SELECT *, CAST(left(published, 4) AS INTEGER) AS year FROM ranked), owned AS (
  SELECT * FROM yearly WHERE year BETWEEN 2016 AND 2025 QUALIFY row_number() OVER (PARTITION BY id ORDER BY category_rank, pos) = 1)
SELECT CAST(y AS INTEGER) AS year, count(o.id) AS count FROM range(2016, 2026) t(y) LEFT JOIN owned o ON o.year = y AND length(o.abstract) % 2 = 0 GROUP BY y""")
def a03(spark, sf):
    rows = _ranked_papers(spark, sf)
    year = statistics.paper_year(F.col("published"), F.col("updated"))
    return statistics.yearly_counts(rows, 2016, 2025, F.length("abstract") % 2 == 0, year)


@query("a04_year_by_owner", f"""WITH {S_RANKED}, owned AS (SELECT * FROM ranked WHERE left(updated, 4) = '2020' QUALIFY row_number() OVER (PARTITION BY id ORDER BY category_rank, pos) = 1)
SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS count FROM owned WHERE length(abstract) % 2 = 0 GROUP BY ROLLUP (category)""")
def a04(spark, sf):
    return statistics.year_by_owner(_ranked_papers(spark, sf), 2020, year_of(F.col("updated")), F.length("abstract") % 2 == 0)


@query("a05_category_by_year", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) AS total FROM orders GROUP BY 1""")
def a05(spark, sf):
    return statistics.category_by_year(table(spark, sf, "orders"), F.year("o_orderdate"), "o_orderstatus", ["F", "O", "P"])


@query("a06_kept_ratio", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, count(*) AS total, count(*) FILTER (o_totalprice >= 200000) AS kept,
  round(count(*) FILTER (o_totalprice >= 200000) / count(*), 4) AS ratio FROM orders GROUP BY 1, 2""")
def a06(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category"), "o_totalprice")
    return statistics.kept_ratio(o, F.col("o_totalprice") >= 200000, ["year", "category"])


# Window probabilities: each sentence lies in the windows that start at it, one and two before it.
def _window_probs(spark, sf):
    rows = document_sentences(spark, sf)
    near = rows.select("paper_name", F.explode(F.sequence(F.greatest(F.lit(0), F.col("gid") - 2), F.col("gid"))).alias("window_id"), "gid", "text")
    p = (F.length("text") + F.col("window_id") * 7) % 100 / 100.0
    return near.select("paper_name", "window_id", "gid", p.alias("prob"), (p >= 0.5).cast("int").alias("label"))


S_WINDOW_PROBS = S_DOCUMENT_SENTENCES + """,
near AS (SELECT paper_name, gid, text, unnest(range(greatest(0, gid - 2), gid + 1)) AS window_id FROM doc_sents),
probs AS (SELECT paper_name, gid, window_id, CAST((length(text) + window_id * 7) % 100 AS DOUBLE) / 100.0::DOUBLE AS prob FROM near)"""


@query("a07_mean_vote", f"""WITH {S_WINDOW_PROBS}, m AS (SELECT paper_name, gid, avg(prob) AS p FROM probs GROUP BY 1, 2)
SELECT d.paper_name, d.gid, round(coalesce(p, 0.0::DOUBLE), 6) AS prob, CAST(round(coalesce(p, 0.0::DOUBLE), 6) >= 0.5 AS INTEGER) AS label FROM doc_sents d LEFT JOIN m USING (paper_name, gid)""")
def a07(spark, sf):
    return windows.mean_vote(_window_probs(spark, sf), document_sentences(spark, sf).drop("text"))


@query("a08_any_vote", f"WITH {S_WINDOW_PROBS} SELECT paper_name, gid, CAST(max(prob >= 0.5) AS INTEGER) AS label FROM probs GROUP BY 1, 2")
def a08(spark, sf):
    return windows.any_vote(_window_probs(spark, sf))


def _with_neighbour(texts):
    """A scorer that depends on the sentence before in the window."""
    return F.transform(texts, lambda t, i: (F.length(t) + 3 * F.length(F.coalesce(F.get(texts, i - 1), F.lit("")))) % 100 / 100.0)


S_WHOLE_WINDOWS = S_DOCUMENT_SENTENCES + """,
near AS (SELECT paper_name, gid, text, unnest(range(greatest(0, gid - 2), gid + 1)) AS window_id FROM doc_sents),
told AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY paper_name, window_id ORDER BY gid), '') AS before FROM near),
probs AS (SELECT paper_name, gid, CAST((length(text) + 3 * length(before)) % 100 AS DOUBLE) / 100.0::DOUBLE AS prob FROM told)"""


def _whole_windows(spark, sf):
    rows = document_sentences(spark, sf)
    near = rows.select("paper_name", F.explode(F.sequence(F.greatest(F.lit(0), F.col("gid") - 2), F.col("gid"))).alias("window_id"), "gid", "text")
    return hooks.tag_whole_windows(near, _with_neighbour)


@query("x03_whole_windows_any", f"WITH {S_WHOLE_WINDOWS} SELECT paper_name, gid, CAST(max(prob >= 0.5) AS INTEGER) AS label FROM probs GROUP BY 1, 2")
def x03_whole_any(spark, sf):
    return windows.any_vote(_whole_windows(spark, sf))


@query("x03_whole_windows_mean", f"""WITH {S_WHOLE_WINDOWS}, m AS (SELECT paper_name, gid, avg(prob) AS p FROM probs GROUP BY 1, 2)
SELECT paper_name, gid, round(p, 6) AS prob, CAST(round(p, 6) >= 0.5 AS INTEGER) AS label FROM m""")
def x03_whole_mean(spark, sf):
    return windows.mean_vote(_whole_windows(spark, sf), document_sentences(spark, sf).drop("text"))


@query("a09_description", f"""WITH {S_DOCUMENT_SENTENCES}, papers AS (SELECT DISTINCT paper_name FROM doc_sents),
d AS (SELECT paper_name, string_agg(text, ' ' ORDER BY gid) AS t FROM doc_sents WHERE length(text) % 2 = 1 GROUP BY 1)
SELECT paper_name, md5(coalesce(t, '')) AS digest, coalesce(length(t), 0) AS n FROM papers LEFT JOIN d USING (paper_name)""")
def a09(spark, sf):
    rows = document_sentences(spark, sf).withColumn("label", F.length("text") % 2)
    d = sentences.collect_description(rows, ["paper_name"], ["gid"])
    return d.select("paper_name", F.md5("description").alias("digest"), F.length("description").cast("long").alias("n"))


@query("a09_description_cut", f"""WITH d AS (SELECT doc_id, {s_sentences('text')} AS s FROM documents),
j AS (SELECT doc_id, array_to_string(list_filter(s, lambda t: length(t) % 2 = 1), ' ') AS t FROM d)
SELECT doc_id, CASE WHEN length(t) > 2000 THEN rtrim(left(t, 2000)) || ' ...' ELSE t END AS description FROM j""")
def a09_cut(spark, sf):
    labelled = F.transform(split_sentences(F.col("text")), lambda t: F.struct(t.alias("text"), (F.length(t) % 2).alias("label")))
    return table(spark, sf, "documents").select("doc_id", sentences.join_positive(labelled, 2000).alias("description"))


@query("a09_description_capped", f"""WITH {S_SENTENCES}, d AS (SELECT paper_name, coalesce(string_agg(text, ' ' ORDER BY gid) FILTER (label = 1), '') AS t FROM numbered GROUP BY 1)
SELECT paper_name, CASE WHEN length(t) > 2000 THEN rtrim(left(t, 2000)) || ' ...' ELSE t END AS description FROM d""")
def a09_capped(spark, sf):
    """Papers of any length: only sentences in front of the cap are brought together."""
    rows = sentences.global_sentence_ids(corpus_items(spark, sf))
    return sentences.collect_description(rows, ["paper_name"], ["gid"], max_chars=2000)


S_COUNTS = """c AS (SELECT count(*) AS n, count(*) FILTER (predicted_label = 1 AND true_label = 1) AS tp, count(*) FILTER (predicted_label = 1 AND true_label = 0) AS fp,
  count(*) FILTER (predicted_label = 0 AND true_label = 1) AS fn, count(*) FILTER (predicted_label = 0 AND true_label = 0) AS tn FROM preds WHERE true_label <> -100)"""


@query("a10_binary_metrics", f"""WITH {S_PREDICTIONS}, {S_COUNTS}
SELECT n, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def a10(spark, sf):
    return quality.binary_metrics(predictions(spark, sf))


@query("a10_document_metrics", """WITH p AS (SELECT CAST(n_chars % 2 AS INTEGER) AS p, quality AS g FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS n, count(*) FILTER (p = 1 AND g = 1) AS tp, count(*) FILTER (p = 1 AND g = 0) AS fp, count(*) FILTER (p = 0 AND g = 1) AS fn, count(*) FILTER (p = 0 AND g = 0) AS tn FROM p)
SELECT n, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def a10_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("predicted_label"))
    return quality.binary_metrics(d.join(table(spark, sf, "labels").withColumnRenamed("quality", "true_label"), "doc_id"))


@query("a11_confusion_matrix", """SELECT quality AS true_label, count(*) FILTER (n_chars % 2 = 0) AS predicted_0, count(*) FILTER (n_chars % 2 = 1) AS predicted_1
FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def a11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).alias("predicted_label"))
    return quality.confusion_matrix(d.join(table(spark, sf, "labels").withColumnRenamed("quality", "true_label"), "doc_id"))


@query("a12_class_report", f"""WITH {S_PREDICTIONS}, {S_COUNTS},
k AS (SELECT '0' AS label, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM k)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def a12(spark, sf):
    return quality.class_report(predictions(spark, sf).filter(F.col("true_label") != -100))


@query("a13_accuracy_by_paper", f"""WITH {S_PREDICTIONS} SELECT paper_name, count(*) FILTER (predicted_label = true_label) AS correct, count(*) AS total,
  round(count(*) FILTER (predicted_label = true_label) / count(*), 6) AS accuracy FROM preds GROUP BY paper_name""")
def a13(spark, sf):
    return quality.accuracy_by_paper(predictions(spark, sf))


@query("a13_rows_by_paper", f"""WITH {S_PREDICTIONS},
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY paper_name ORDER BY sentence_index) - 1) // 1000 AS BIGINT) AS part FROM preds),
t AS (SELECT paper_name, count(*) FILTER (predicted_label = true_label) AS correct, count(*) AS total, round(count(*) FILTER (predicted_label = true_label) / count(*), 6) AS accuracy FROM preds GROUP BY paper_name)
SELECT paper_name, part, any_value(correct) AS correct, any_value(total) AS total, any_value(accuracy) AS accuracy, count(*) AS n_rows,
  md5(string_agg(sentence_index || ' ' || predicted_label || ' ' || true_label || ' ' || text, chr(10) ORDER BY sentence_index)) AS digest
FROM n JOIN t USING (paper_name) GROUP BY 1, 2""")
def a13_rows(spark, sf):
    nested = quality.rows_by_paper(predictions(spark, sf), "sentence_index", ["predicted_label", "true_label", "text"])
    line = F.transform("rows", lambda r: F.concat_ws(" ", r["sentence_index"], r["predicted_label"], r["true_label"], r["text"]))
    return nested.select(
        "paper_name", "part", "correct", "total", "accuracy", F.size("rows").cast("long").alias("n_rows"), F.md5(F.array_join(line, "\n")).alias("digest")
    )


@query("a14_prediction_statistics", f"""WITH {S_PREDICTIONS} SELECT count(DISTINCT paper_name) AS papers, count(*) AS sentences, count(*) FILTER (predicted_label = true_label) AS correct,
  round(count(*) FILTER (predicted_label = true_label) / count(*), 6) AS accuracy, count(*) FILTER (predicted_label = 1) AS positives, round(count(*) FILTER (predicted_label = 1) / count(*), 6) AS positive_ratio FROM preds""")
def a14(spark, sf):
    return quality.prediction_statistics(predictions(spark, sf))


@query("a15_error_counts", f"""WITH {S_PREDICTIONS} SELECT paper_name, count(*) AS total, count(*) FILTER (predicted_label = true_label) AS correct,
  count(*) FILTER (predicted_label = 1 AND true_label = 0) AS false_positives, count(*) FILTER (predicted_label = 0 AND true_label = 1) AS false_negatives FROM preds GROUP BY paper_name""")
def a15(spark, sf):
    return quality.error_counts(predictions(spark, sf), ["paper_name"])


@query("a16_confidence_histogram", f"""WITH {S_PREDICTIONS}, u AS (
  SELECT CAST(confidence AS DOUBLE) AS c, CASE true_label WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS subset FROM preds
  UNION ALL SELECT CAST(confidence AS DOUBLE), CASE WHEN predicted_label = true_label THEN 'correct' ELSE 'incorrect' END FROM preds),
r AS (SELECT subset, min(c) AS lo, max(c) AS hi FROM u WHERE subset IS NOT NULL GROUP BY subset)
SELECT subset, CAST(least(floor((c - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM u JOIN r USING (subset) GROUP BY 1, 2""")
def a16(spark, sf):
    return quality.confidence_histogram(predictions(spark, sf))


_KS = [1, 3, 5, 10]
S_METRICS = f"""{S_TOP10}, {S_TRUTH},
sizes AS (SELECT query_id, count(*) AS rel FROM truth GROUP BY 1),
hits AS (SELECT t.query_id, t.rank, CAST(r.link IS NOT NULL AS INTEGER) AS hit FROM top10 t LEFT JOIN truth r ON r.query_id = t.query_id AND r.link = t.cand_id),
running AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM hits),
cut_at AS (SELECT query_id, k, CAST(sum(hit) AS DOUBLE) AS h, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit / log2(rank + 1)) AS dcg, sum(hit * so_far / rank) AS run
  FROM running, (SELECT unnest({_KS}) AS k) WHERE rank <= k GROUP BY 1, 2),
m AS (SELECT query_id, CAST(k AS INTEGER) AS k, CAST(h > 0 AS DOUBLE) AS hit_rate, coalesce(1.0::DOUBLE / first, 0) AS mrr, h / k AS precision, h / least(rel, k) AS recall,
  CASE WHEN h > 0 THEN 2 * (h / k) * (h / least(rel, k)) / (h / k + h / least(rel, k)) ELSE 0 END AS f1,
  dcg / list_sum(list_transform(range(1, least(rel, k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, run / least(rel, k) AS average_precision FROM cut_at JOIN sizes USING (query_id))"""


def _ranked(spark, sf):
    found = retrieval.cosine_top_k(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 10)
    return found.select("query_id", "rank", F.col("cand_id").alias("link"))


@query("f33_ranking_metrics", f"WITH {S_METRICS} SELECT query_id, k, {', '.join(f'round({m}, 6) AS {m}' for m in retrieval.METRICS)} FROM m")
def f33(spark, sf):
    m = retrieval.ranking_metrics(_ranked(spark, sf), _truth(spark, sf), _KS)
    return m.select("query_id", "k", *[F.round(c, 6).alias(c) for c in retrieval.METRICS])


@query("a17_mean_metrics", f"""WITH {S_METRICS}, l AS (UNPIVOT (SELECT * FROM m) ON {', '.join(retrieval.METRICS)} INTO NAME metric VALUE value)
SELECT metric, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS num_valid_queries FROM l GROUP BY 1, 2""")
def a17(spark, sf):
    m = retrieval.mean_metrics(retrieval.ranking_metrics(_ranked(spark, sf), _truth(spark, sf), _KS))
    return m.select("metric", "k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "num_valid_queries")


@query("a18_source_coverage", "SELECT count(*) FILTER (contains(html, '<article>')) AS have, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (contains(html, '<article>')) / count(*), 2) AS percent FROM pages")
def a18(spark, sf):
    return statistics.source_coverage(table(spark, sf, "pages"), F.col("html").contains("<article>"))


@query("a19_corpus_size", f"WITH {S_SENTENCES} SELECT count(DISTINCT paper_name) AS papers, count(*) AS items, CAST(sum(len(s)) AS BIGINT) AS sentences FROM items")
def a19(spark, sf):
    return statistics.corpus_size(corpus_items(spark, sf))


S_SHARDED = S_SENTENCES + """,
first_seen AS (SELECT paper_name, min(paragraph_id) AS p FROM items GROUP BY 1),
placed AS (SELECT paper_name, CAST(floor((row_number() OVER (ORDER BY p) - 1) / ceil((SELECT count(*) FROM first_seen) / 3)) AS INTEGER) AS shard FROM first_seen)"""


def _sharded(spark, sf, k=3):
    items = corpus_items(spark, sf)
    seen = splits.first_seen_papers(items, "paragraph_id", F.size("sentences"))
    placed = splits.equal_shards(seen, k).select(F.col("paper").alias("paper_name"), "shard")
    return items.join(placed, "paper_name")


@query("a20_shard_index", f"""WITH {S_SHARDED} SELECT shard, paper_name, count(*) AS paragraphs, CAST(sum(len(s)) AS BIGINT) AS sentences FROM items JOIN placed USING (paper_name) GROUP BY 1, 2""")
def a20(spark, sf):
    return splits.shard_index(_sharded(spark, sf), F.size("sentences"))


@query("a20_shard_summary", f"""WITH {S_SHARDED}, i AS (SELECT shard, paper_name, count(*) AS paragraphs, sum(len(s)) AS sentences FROM items JOIN placed USING (paper_name) GROUP BY 1, 2)
SELECT shard, CAST(grouping(shard) AS INTEGER) AS is_total, count(*) AS papers, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(sentences) AS BIGINT) AS sentences FROM i GROUP BY ROLLUP (shard)""")
def a20_summary(spark, sf):
    return splits.shard_summary(splits.shard_index(_sharded(spark, sf), F.size("sentences")))


@query("a21_fingerprints", f"WITH {S_SENTENCES} SELECT paper_name, section, pos, sha1(text) AS digest, count(*) AS n FROM sents GROUP BY 1, 2, 3, 4")
def a21(spark, sf):
    return splits.fingerprints(sentences.explode_sentences(corpus_items(spark, sf)), ["paper_name", "section", "pos"])


@query("a22_distinct_in_order", f"WITH {S_DOCUMENT_SENTENCES} SELECT text, min(paper_name * 1000000 + gid) AS pos FROM doc_sents GROUP BY text")
def a22(spark, sf):
    rows = document_sentences(spark, sf).select("text", (F.col("paper_name") * 1000000 + F.col("gid")).alias("pos"))
    return ledger.distinct_in_order(rows, "text", "pos")


@query("a23_token_usage", """SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS output_tokens,
  CAST(sum(length(text)) AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id""")
def a23(spark, sf):
    n = F.length("text")
    rows = table(spark, sf, "conversations").select(
        "conv_id", F.when(F.col("role") == "user", n).otherwise(0).alias("input_tokens"),
        F.when(F.col("role") != "user", n).otherwise(0).alias("output_tokens"), n.alias("total_tokens"),
    )
    return statistics.token_usage(rows, ["conv_id"])


# --- W: windows and ordered groups -------------------------------------------------------------


def _batch(spark, sf, side: int):
    """Page links as ledger rows; the older side writes the same links with a slash and in capitals."""
    rows = page_links(spark, sf)
    url = F.col("url") if side else F.concat(F.replace("url", F.lit("https:"), F.lit("HTTP:")), F.lit("/"))
    return rows.select(
        F.concat(F.lit(PDF), F.floor(F.col("paper_id") / 2).cast("string"), F.lit(".pdf")).alias("Paper Link"),
        F.when(F.col("pos") == 7, "").otherwise(F.when(F.col("url").contains("?"), F.concat(F.lit("https://x.org/"), F.col("pos").cast("string"))).otherwise(url)).alias("Dataset Link"),
        F.col("anchor").alias("Dataset Description"), F.lit("new" if side else "old").alias("Timestamp"),
        (F.col("paper_id") * 1000 + F.col("pos")).alias("pos"),
    )


def s_batch(side: int) -> str:
    url = "url" if side else "replace(url, 'https:', 'HTTP:') || '/'"
    return f"""SELECT '{PDF}' || paper_id // 2 || '.pdf' AS p, CASE WHEN pos = 7 THEN '' WHEN contains(url, '?') THEN 'https://x.org/' || pos ELSE {url} END AS d,
  anchor AS t, '{'new' if side else 'old'}' AS ts, paper_id * 1000 + pos AS pos, {1 - side} AS b FROM page_links"""


S_BATCHES = f"""{S_PAGE_LINKS}, rows AS ({s_batch(1)} UNION ALL {s_batch(0)})"""
_LEDGER_OUT = 'p AS "Paper Link", d AS "Dataset Link", t AS "Dataset Description", ts AS "Timestamp", pos'


@query("w01_keep_first", f"""WITH {S_BATCHES}
SELECT {_LEDGER_OUT} FROM rows WHERE d <> '' QUALIFY row_number() OVER (PARTITION BY {s_norm('p')}, {s_norm('d')} ORDER BY b, pos) = 1""")
def w01(spark, sf):
    return ledger.dedupe_records(_batch(spark, sf, 1), _batch(spark, sf, 0), ["pos"])


@query("w01_keep_first_old", f"""WITH {S_BATCHES} SELECT {_LEDGER_OUT} FROM rows QUALIFY row_number() OVER (PARTITION BY p, d ORDER BY 1 - b, pos) = 1""")
def w01_old(spark, sf):
    return ledger.dedupe_records(_batch(spark, sf, 1), _batch(spark, sf, 0), ["pos"], prefer="old", normalised=False)


@query("w01_link_corpus", f"""WITH {S_BATCHES} SELECT p AS "Paper Link", d AS "URL", split_part(t, ' ', 2) AS "Label", pos FROM rows
QUALIFY row_number() OVER (PARTITION BY {s_norm('p')}, {s_norm('d')}, split_part(t, ' ', 2) ORDER BY 1 - b, pos) = 1""")
def w01_corpus(spark, sf):
    def side(i):
        return _batch(spark, sf, i).select("Paper Link", F.col("Dataset Link").alias("URL"), F.split("Dataset Description", " ")[1].alias("Label"), "pos")

    return ledger.dedupe_link_corpus(side(0), side(1), ["pos"])


@query("w02_keep_last", """SELECT user_id, min(event_id) AS pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def w02(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), "event_type", "value")
    return ledger.keep_last(rows, "user_id", "pos")


@query("w03_global_ids", f"WITH {S_SENTENCES} SELECT paper_name, section, paragraph_id, pos, gid FROM numbered")
def w03(spark, sf):
    rows = sentences.global_sentence_ids(corpus_items(spark, sf))
    return rows.select("paper_name", "section", "paragraph_id", "pos", "gid")


def _token_rows(spark, sf):
    rows = sentences.global_sentence_ids(corpus_items(spark, sf))
    return rows.withColumn("tokens", count_tokens(F.col("text")))


def s_windows(training: bool) -> str:
    """The same windows by recursion: steps of all positions first, then one walk per paper."""
    positive = "ft IS NOT NULL AND ft < least(i + size, n)" if training else "FALSE"
    return f"""RECURSIVE {S_SENTENCES},
t AS (SELECT paper_name, gid, label, len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS k FROM numbered),
pos AS (SELECT paper_name, gid AS i, sum(k + 1) OVER w - (k + 1) AS p, sum(k) OVER w - k AS c, count(*) OVER (PARTITION BY paper_name) AS n,
  min(CASE WHEN label = 1 THEN gid END) OVER (PARTITION BY paper_name ORDER BY gid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ft
  FROM t WINDOW w AS (PARTITION BY paper_name ORDER BY gid ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT paper_name, i, p, c FROM pos UNION ALL SELECT paper_name, max(gid) + 1, sum(k + 1), sum(k) FROM t GROUP BY paper_name),
sized AS (SELECT s.*, greatest(3, e.i - s.i) AS size FROM (SELECT *, p + {WindowConfig().max_tokens - 3} AS bound FROM pos) s ASOF JOIN ends e ON s.paper_name = e.paper_name AND s.bound > e.p),
steps AS MATERIALIZED (SELECT *, {positive} AS pos, greatest(1, CASE WHEN {positive} THEN size // 3 ELSE size // 2 END) AS step FROM sized),
walk AS (SELECT paper_name, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT paper_name FROM t) UNION ALL
  SELECT w.paper_name, CAST(w.i + s.step AS BIGINT) FROM walk w JOIN steps s ON s.paper_name = w.paper_name AND s.i = w.i WHERE w.i + s.step < s.n),
spans AS (SELECT s.paper_name, s.i, CASE WHEN s.pos THEN greatest(s.i, ft - 2) ELSE s.i END AS a,
  CASE WHEN s.pos THEN least(s.i + size, n, ft + 3) ELSE least(s.i + size, n) END AS b, s.pos FROM walk JOIN steps s USING (paper_name, i))
SELECT s.paper_name, s.i AS window_id, CAST(a AS BIGINT) AS first, CAST(b - 1 AS BIGINT) AS last, CAST(y.c - x.c AS BIGINT) AS window_tokens, pos AS has_positive FROM spans s
JOIN ends x ON x.paper_name = s.paper_name AND x.i = a JOIN ends y ON y.paper_name = s.paper_name AND y.i = b WHERE b - a >= 3"""


@query("w04_token_windows", f"WITH {s_windows(False)}")
def w04(spark, sf):
    return windows.token_windows(_token_rows(spark, sf), WindowConfig())


@query("w04_training_windows", f"WITH {s_windows(True)}")
def w04_training(spark, sf):
    return windows.token_windows(_token_rows(spark, sf), WindowConfig(), training=True)


@query("w05_pivot_window", f"""WITH RECURSIVE d AS (SELECT doc_id, {s_sentences('text')} AS s FROM documents),
q AS (SELECT doc_id, len(s) // 2 AS p, list_concat(list_append(s[1:len(s) // 2], '[URL_PIVOT] ' || doc_id), s[len(s) // 2 + 1:]) AS q FROM d),
k AS (SELECT *, len(q) AS n, list_transform(q, lambda t: len(regexp_extract_all(t, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]'))) AS k FROM q),
c AS MATERIALIZED (SELECT doc_id, p, n, list_concat([0], list_transform(range(1, n + 1), lambda i: list_sum(k[1:i]))) AS c FROM k),
walk AS (SELECT doc_id, CAST(greatest(0, p - 2) AS BIGINT) AS a, CAST(least(n, p + 3) AS BIGINT) AS b, TRUE AS moved FROM c UNION ALL
  SELECT doc_id, a2, CASE WHEN b < n AND c[b + 2] - c[a2 + 1] + b - a2 <= 510 THEN b + 1 ELSE b END, a2 < a OR (b < n AND c[b + 2] - c[a2 + 1] + b - a2 <= 510) FROM (
    SELECT doc_id, n, c, a, b, CASE WHEN a > 0 AND c[b + 1] - c[a] + b - a <= 510 THEN a - 1 ELSE a END AS a2 FROM walk JOIN c USING (doc_id) WHERE moved))
SELECT doc_id, CAST(b - a AS INTEGER) AS n, md5(array_to_string(q[a + 1:b], '|')) AS digest FROM walk JOIN q USING (doc_id) WHERE NOT moved""")
def w05(spark, sf):
    """Windows around a link put between the sentences of a document."""
    s = split_sentences(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s")).withColumn("half", F.floor(F.size("s") / 2).cast("int"))
    d = d.select("doc_id", F.slice("s", 1, F.col("half")).alias("before"), F.slice("s", F.col("half") + 1, F.size("s")).alias("after"))
    pivot = F.concat(F.lit("[URL_PIVOT] "), F.col("doc_id").cast("string"))
    tokens = F.transform(F.concat("before", F.array(pivot), "after"), count_tokens)
    window = windows.pivot_window(F.col("before"), F.col("after"), pivot, tokens, max_tokens=512)
    return d.select("doc_id", window.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", "|")).alias("digest"))


@query("w06_context", f"""WITH {S_SENTENCES}
SELECT paper_name, gid, coalesce(lag(text, 2) OVER w || '|', '') || coalesce(lag(text, 1) OVER w, '') AS before,
  coalesce(lead(text, 1) OVER w, '') || coalesce('|' || lead(text, 2) OVER w, '') AS after FROM numbered WINDOW w AS (PARTITION BY paper_name ORDER BY gid)""")
def w06(spark, sf):
    rows = sentences.global_sentence_ids(corpus_items(spark, sf)).select("paper_name", "gid", "text")
    found = sentences.neighbour_context(rows, ["paper_name"], "gid")
    return found.select("paper_name", "gid", F.array_join("ctx_before", "|").alias("before"), F.array_join("ctx_after", "|").alias("after"))


@query("w06_array_context", f"""WITH d AS (SELECT doc_id, {s_sentences('text')} AS s FROM documents), h AS (SELECT *, len(s) // 2 AS i FROM d)
SELECT doc_id, array_to_string(s[greatest(i - 1, 1):i], '|') AS before, array_to_string(s[i + 2:i + 3], '|') AS after FROM h""")
def w06_array(spark, sf):
    """Neighbours of the middle sentence of every document, without a shuffle."""
    s = split_sentences(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", s.alias("s")).withColumn("i", F.floor(F.size("s") / 2).cast("int"))
    before, after = sentences.array_context(F.col("s"), F.col("i"))
    return d.select("doc_id", F.array_join(before, "|").alias("before"), F.array_join(after, "|").alias("after"))


def _scored(spark, sf):
    return links.score_candidates(links.with_url_keys(page_links(spark, sf)).withColumn("ctx", F.lit("")), reasons=False)


@query("w07_top_candidates", f"""WITH {S_SCORED} SELECT paper_id, pos, url, score, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM scored QUALIFY rank <= 5""")
def w07(spark, sf):
    return top_rows(_scored(spark, sf), ["paper_id"], [F.col("score").desc(), F.col("pos")], 5).select("paper_id", "pos", "url", "score", "rank")


S_LEAD = S_SCORED + """,
ordered AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score, count(*) OVER (PARTITION BY paper_id) AS n FROM scored WINDOW w AS (PARTITION BY paper_id ORDER BY score DESC, pos))"""


@query("w08_clear_lead", f"WITH {S_LEAD} SELECT paper_id, score, (score >= 22 OR coalesce(score >= 16 AND score - next_score >= 5, FALSE)) AS clear FROM ordered WHERE rank = 1")
def w08(spark, sf):
    top = links.leading_candidates(_scored(spark, sf))
    return top.select("paper_id", F.get("top", 0)["score"].alias("score"), links.has_clear_lead(F.col("top")).alias("clear"))


@query("w09_first_non_blank", f"""WITH old AS ({s_ledger_side(0)})
SELECT p AS "Paper Link", coalesce(arg_min(d, pos) FILTER (trim(d) <> ''), '') AS "Dataset Link", coalesce(arg_min(t, pos) FILTER ({s_strip('t')} <> ''), '') AS "Dataset Description" FROM old GROUP BY p""")
def w09(spark, sf):
    return ledger.first_non_blank(_ledger_side(spark, sf, 0), ["Paper Link"], ["pos"], ["Dataset Link", "Dataset Description"])


@query("w10_result_rank", f"WITH {S_TOP10} SELECT query_id, cand_id, CAST(rank AS INTEGER) AS rank FROM top10")
def w10(spark, sf):
    return retrieval.cosine_top_k(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 10).select("query_id", "cand_id", "rank")


@query("w11_average_precision", f"WITH {S_METRICS} SELECT query_id, k, round(average_precision, 6) AS average_precision FROM m")
def w11(spark, sf):
    m = retrieval.ranking_metrics(_ranked(spark, sf), _truth(spark, sf), _KS)
    return m.select("query_id", "k", F.round("average_precision", 6).alias("average_precision"))


@query("w12_first_hit", f"WITH {S_METRICS} SELECT query_id, k, round(mrr, 6) AS mrr FROM m")
def w12(spark, sf):
    m = retrieval.ranking_metrics(_ranked(spark, sf), _truth(spark, sf), _KS)
    return m.select("query_id", "k", F.round("mrr", 6).alias("mrr"))


@query("w13_chunks", f"WITH {S_SENTENCES} SELECT paper_name, CAST(gid // 100 AS BIGINT) AS chunk, count(*) AS n FROM numbered GROUP BY 1, 2")
def w13(spark, sf):
    rows = sentences.global_sentence_ids(corpus_items(spark, sf))
    return sentences.chunk_sentences(rows, ["paper_name"], "gid", 100).groupBy("paper_name", "chunk").agg(F.count(F.lit(1)).alias("n"))


_PACK = PackConfig()
S_PACK = f"""RECURSIVE {S_SENTENCES},
t AS (SELECT paper_name, gid, least(length(text), {_PACK.cut}) + CASE WHEN length(text) > {_PACK.cut} THEN 3 ELSE 0 END + length(CAST(gid + 1 AS VARCHAR)) + 5 AS k FROM numbered),
pos AS (SELECT paper_name, gid AS i, sum(k) OVER w AS upto, sum(k) OVER w - k AS before, count(*) OVER (PARTITION BY paper_name) AS n FROM t WINDOW w AS (PARTITION BY paper_name ORDER BY gid ROWS UNBOUNDED PRECEDING)),
reach AS (SELECT paper_name, i, upto + length(CAST(i + 1 AS VARCHAR)) AS q FROM pos),
sized AS (SELECT s.paper_name, s.i, s.n, coalesce(least(e.i - s.i + 1, {_PACK.max_items}), 0) AS taken FROM (
  SELECT *, before + {_PACK.budget} - {len(LABEL_REQUEST) - len("{title}{first}{last}")} - length(paper_name) - length(CAST(i + 1 AS VARCHAR)) + 1 AS bound FROM pos) s
  ASOF LEFT JOIN reach e ON s.paper_name = e.paper_name AND s.bound >= e.q),
steps AS MATERIALIZED (SELECT paper_name, i, n, greatest(taken, 0) AS taken, greatest(taken, 1) AS step FROM sized),
walk AS (SELECT paper_name, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT paper_name FROM t) UNION ALL
  SELECT w.paper_name, CAST(w.i + s.step AS BIGINT) FROM walk w JOIN steps s ON s.paper_name = w.paper_name AND s.i = w.i WHERE w.i + s.step < s.n)
SELECT paper_name, i AS first, CAST(i + step - 1 AS BIGINT) AS last, CAST(CASE WHEN taken = 0 THEN {max(200, _PACK.budget // 8)} ELSE {_PACK.cut} END AS BIGINT) AS cut FROM walk JOIN steps USING (paper_name, i)"""


@query("w14_character_packing", f"WITH {S_PACK}")
def w14(spark, sf):
    rows = sentences.global_sentence_ids(corpus_items(spark, sf)).withColumn("n_chars", F.length("text"))
    return windows.pack_by_characters(rows, _PACK)


@query("w15_equal_shards", f"WITH {S_SHARDED} SELECT paper_name AS paper, shard FROM placed")
def w15(spark, sf):
    seen = splits.first_seen_papers(corpus_items(spark, sf), "paragraph_id", F.size("sentences"))
    return splits.equal_shards(seen, 3).select("paper", "shard")


@query("w16_balanced_shards", f"""WITH RECURSIVE sized AS (SELECT doc_id, CAST(len({s_sentences('text')}) AS BIGINT) AS size FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, doc_id) AS rn FROM sized),
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS paper, CAST(0 AS BIGINT) AS size, CAST(-1 AS INTEGER) AS shard, CAST(0 AS BIGINT) AS l0, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2, CAST(0 AS BIGINT) AS l3 UNION ALL
  SELECT rn, doc_id, size, s, l0 + CASE WHEN s = 0 THEN size ELSE 0 END, l1 + CASE WHEN s = 1 THEN size ELSE 0 END, l2 + CASE WHEN s = 2 THEN size ELSE 0 END, l3 + CASE WHEN s = 3 THEN size ELSE 0 END FROM (
    SELECT o.rn, o.doc_id, o.size, l0, l1, l2, l3, CAST(CASE least(l0, l1, l2, l3) WHEN l0 THEN 0 WHEN l1 THEN 1 WHEN l2 THEN 2 ELSE 3 END AS INTEGER) AS s FROM g JOIN o ON o.rn = g.rn + 1))
SELECT CAST(paper AS VARCHAR) AS paper, size, shard FROM g WHERE rn > 0""")
def w16(spark, sf):
    """Greedy by size, from the histogram of sizes; the SQL is the sequential greedy."""
    d = table(spark, sf, "documents")
    size = F.size(split_sentences(F.col("text"))).cast("long")
    rows = d.select(F.col("doc_id").cast("string").alias("paper"), F.col("doc_id").alias("first_pos"), size.alias("size"))
    return splits.balanced_shards(staged(rows, "sizes"), 4).select("paper", "size", "shard")


def _split_papers(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("paper"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("n_chars").alias("size"))


S_SPLIT = """papers AS (SELECT doc_id AS paper, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, n_chars AS size FROM documents)"""


@query("w17_adjust_by_papers", f"""WITH {S_SPLIT}, t AS (SELECT CAST(round_even(count(*) / 12, 0) AS BIGINT) - count(*) FILTER (split = 'test') AS need FROM papers),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42' || paper), paper) - 1 AS rn FROM papers)
SELECT paper, CASE WHEN split = 'train' AND rn < need THEN 'test' WHEN split = 'test' AND rn < -need THEN 'train' ELSE split END AS split, size FROM r, t""")
def w17(spark, sf):
    return splits.adjust_by_papers(_split_papers(spark, sf))


@query("w17_adjust_by_sentences", f"""WITH {S_SPLIT}, t AS (SELECT round_even(sum(size) / 12, 0) AS target, sum(size) FILTER (split = 'test') AS now FROM papers),
b AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY size DESC, md5('42' || paper), paper) AS rn FROM papers),
c AS (SELECT rn, size FROM b WHERE split = 'test' AND rn <= 3),
s AS (SELECT now, target, now - (SELECT size FROM c WHERE rn = 1) AS n1, now - (SELECT sum(size) FROM c WHERE rn <= 2) AS n2, now - (SELECT sum(size) FROM c) AS n3 FROM t)
SELECT paper, CASE WHEN split = 'test' AND rn <= 3 AND n2 > target AND abs(n3 - target) < abs(now - target) THEN 'train' ELSE split END AS split, size FROM b, s""")
def w17_sentences(spark, sf):
    return splits.adjust_by_sentences(_split_papers(spark, sf))


@query("w18_stratified_split", """WITH n AS (SELECT source, count(*) AS n, round(count(*) * 0.9::DOUBLE) AS quota FROM documents GROUP BY 1),
n2 AS (SELECT n.*, t.total FROM n, (SELECT count(*) AS total FROM documents) t),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) - 1 AS rn FROM documents)
SELECT doc_id, source, CASE WHEN rn < CASE WHEN total <= 4000 THEN quota ELSE round(n * (4000.0::DOUBLE / total)) END THEN 'train' ELSE 'eval' END AS part FROM r JOIN n2 USING (source)""")
def w18(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return splits.stratified_split(rows, "source", "doc_id").select("doc_id", "source", "part")


@query("w18_paper_split", """SELECT doc_id AS paper, CASE WHEN row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) - 1 < ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM documents""")
def w18_papers(spark, sf):
    return splits.paper_split(table(spark, sf, "documents").select(F.col("doc_id").alias("paper"))).select("paper", "part")


@query("w19_suggest_test_size", f"WITH {S_SPLIT} SELECT round(round_even(count(*) / 12, 0) / count(*) FILTER (split = 'train'), 6) AS test_size FROM papers")
def w19(spark, sf):
    return splits.suggest_test_size(_split_papers(spark, sf))


def _occurrences(spark, sf):
    """Links of every page, each with the window of sentences around its own place."""
    return links.link_windows(links.extract_links(page_sources(spark, sf), window=LinkConfig().probe_sentences))


S_CANDIDATES = f"""{S_PAGE_SOURCES},
normed AS (SELECT *, {s_norm('url')} AS norm_url FROM page_windows),
hosted AS (SELECT *, {s_host_path('norm_url')} AS host_path FROM normed),
firsts AS (SELECT * FROM hosted QUALIFY row_number() OVER (PARTITION BY paper_id, norm_url ORDER BY pos) = 1),
plain AS (SELECT *, list_transform(ws[1:6], lambda x: {s_latex('x')}) AS cs FROM firsts),
ctxed AS (SELECT * EXCLUDE (cs, ws), left(array_to_string(list_filter(list_transform(cs, lambda x: {s_latex_kept('x')}), lambda x: x <> ''), ' '), 2000) AS ctx FROM plain),
cands AS (SELECT paper_id, pos, url, anchor, norm_url, host_path, ctx, {s_score("lower(anchor || ' ' || ctx)")} AS score FROM ctxed)"""


@query("w20_candidates", f"WITH {S_CANDIDATES} SELECT paper_id, url, anchor, ctx, score FROM cands")
def w20(spark, sf):
    return links.build_candidates(_occurrences(spark, sf), ["form", "pos"]).select("paper_id", "url", "anchor", "ctx", "score")


@query("w21_global_index", "SELECT o_orderpriority AS category, CAST(month(o_orderdate) AS INTEGER) AS page, o_orderkey AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month(o_orderdate), o_orderkey) - 1 AS global_index FROM orders")
def w21(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.month("o_orderdate").alias("page"), F.col("o_orderkey").alias("item"))
    return ledger.global_index(rows, "category", "page", "item")


# --- O: sorts and picks ------------------------------------------------------------------------


@query("o01_corpus_sort", "SELECT source AS paper_name, lang AS section, CAST(doc_id AS INTEGER) AS paragraph_id FROM documents")
def o01(spark, sf):
    return corpus_items(spark, sf).drop("sentences").orderBy("paper_name", "section", "paragraph_id")


@query("o02_cosine_top_k", f"WITH {S_TOP10} SELECT query_id, cand_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top10")
def o02(spark, sf):
    found = retrieval.cosine_top_k(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 10)
    return found.withColumn("score", F.round("score", 6))


@query("o03_inner_product_top_k", """WITH sims AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings c)
SELECT query_id, cand_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cand_id) AS INTEGER) AS rank FROM sims QUALIFY rank <= 5""")
def o03(spark, sf):
    """The order of a flat inner-product index; ``k`` beyond the corpus gives the whole corpus."""
    found = retrieval.cosine_top_k(_vectors(spark, sf, "query_id"), _vectors(spark, sf, "cand_id"), 5, inner=True)
    return found.select("query_id", "cand_id", "rank")


def _records(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit(PDF), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("Paper Link"), F.concat(F.lit("https://"), F.col("source"), F.lit(".org")).alias("Dataset Link"),
        F.col("text").alias("Dataset Description"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")).alias("Timestamp"), "doc_id",
    )


@query("o04_latest", "SELECT doc_id, '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS \"Timestamp\" FROM documents ORDER BY 2 DESC, 1 LIMIT 50")
def o04(spark, sf):
    return retrieval.latest_records(_records(spark, sf), 50, tie=["doc_id"]).select("doc_id", "Timestamp")


def s_count(e: str, token: str) -> str:
    return f"(length({e}) - length(replace({e}, '{token}', ''))) // {len(token)}"


S_KEYWORDS = f"""WITH t AS (SELECT doc_id, lower('{PDF}' || doc_id || '.pdf https://' || source || '.org ' || text) AS x FROM documents),
s AS (SELECT doc_id, CAST({s_count('x', 'the')} + {s_count('x', 'tion')} + {s_count('x', 'src1')} AS INTEGER) AS score FROM t)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"""


@query("o05_keyword_search", S_KEYWORDS)
def o05(spark, sf):
    return retrieval.keyword_search(_records(spark, sf), " The tion  SRC1 ", tie=["doc_id"]).select("doc_id", "score")


@query("o05_postings_search", S_KEYWORDS)
def o05_postings(spark, sf):
    """The same search on a written index of character grams."""
    records, path = _records(spark, sf), new_work_dir(spark, "postings")
    postings.write_postings(records, path, "doc_id")
    return postings.search_postings(records, path, " The tion  SRC1 ", "doc_id", tie=["doc_id"]).select("doc_id", "score")


@query("o06_best_link", f"""WITH {S_PAGE_LINKS}, u AS (SELECT paper_id, pos, CASE WHEN pos % 4 = 0 THEN 'https://arxiv.org/abs/1' ELSE rtrim(regexp_extract(url, '(?i)https?://[^\\s<>\\])"}}]+'), '.,;:)]}}"''') END AS url FROM page_links),
k AS (SELECT *, coalesce(list_min(list_filter([{', '.join(f"CASE WHEN contains(lower(url), '{d}') THEN {i} END" for i, d in enumerate(rules.DOMAIN_ORDER))}], lambda r: r IS NOT NULL)), 999) AS rank FROM u WHERE NOT contains(lower(url), 'arxiv.org'))
SELECT p.page_id AS paper_id, coalesce(k.url, '') AS link FROM pages p LEFT JOIN (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY rank, length(url), pos) = 1) k ON k.paper_id = p.page_id""")
def o06(spark, sf):
    def text(x):
        return F.concat(F.lit("see "), F.when(x["pos"] % 4 == 0, "https://arxiv.org/abs/1").otherwise(x["url"]), F.lit("). Next"))

    return pages_with_links(spark, sf).select("paper_id", urls.best_link(F.transform("links", text)).alias("link"))


S_PREFERRED = f"""({s_any('host_path', rules.PREFERRED_HOSTS)} OR (contains(host_path, 'github.com') AND contains(host_path, '/releases'))
  OR (contains(host_path, 'github.com') AND (contains(host_path, '/blob/main/data') OR contains(host_path, '/tree/main/data'))))"""
_ENDS = "(" + " OR ".join("ends_with({u}, '" + e + "')" for e, _ in rules.FILE_ENDING_WEIGHTS) + ")"


def s_landing(u: str) -> str:
    return f"CASE WHEN {_ENDS.format(u=u)} THEN 0 ELSE 1 END"


S_CLASS = f"""CASE WHEN contains(host_path, 'huggingface.co/datasets') THEN 5 WHEN {s_any('host_path', rules.HOST_CLASSES[1][1])} THEN 4
  WHEN contains(host_path, 'github.com') AND (contains(host_path, '/releases') OR contains(host_path, '/blob/main/data') OR contains(host_path, '/tree/main/data')) THEN 3
  WHEN contains(host_path, 'storage.googleapis.com') THEN 2 WHEN contains(host_path, 'drive.google.com') THEN 1 ELSE 0 END"""


def s_picks(source: str) -> str:
    """Preferred pick, rule pick and top pick per paper over scored candidates."""
    return f"""
ord AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score, count(*) OVER (PARTITION BY paper_id) AS n FROM {source} WINDOW w AS (PARTITION BY paper_id ORDER BY score DESC, pos)),
top5 AS (SELECT * FROM ord WHERE rank <= 5),
preferred AS (SELECT * FROM top5 WHERE {S_PREFERRED} QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, {s_landing('norm_url')} DESC, rank) = 1),
classed AS (SELECT * FROM top5 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY {S_CLASS} DESC, {s_landing('lower(url)')} DESC, score DESC, length(url), rank) = 1),
direct AS (SELECT * FROM ord WHERE rank = 1 AND (n = 1 OR score >= 22 OR (score >= 16 AND score - next_score >= 5))),
ruled AS (SELECT * FROM direct UNION ALL SELECT * FROM classed WHERE score >= 15 AND paper_id NOT IN (SELECT paper_id FROM direct)),
leader AS (SELECT * FROM ord WHERE rank = 1)"""


@query("o07_preferred_pick", f"WITH {S_SCORED}, {s_picks('scored')} SELECT paper_id, url, score FROM preferred")
def o07(spark, sf):
    top = links.leading_candidates(_scored(spark, sf)).select("paper_id", links.preferred_pick(F.col("top")).alias("p"))
    return top.filter("p is not null").select("paper_id", "p.url", "p.score")


@query("o08_rule_pick", f"WITH {S_SCORED}, {s_picks('scored')} SELECT paper_id, url, score FROM ruled")
def o08(spark, sf):
    top = links.leading_candidates(_scored(spark, sf)).select("paper_id", links.rule_pick(F.col("top")).alias("p"))
    return top.filter("p is not null").select("paper_id", "p.url", "p.score")


@query("o09_primary_link", f"""WITH {S_CANDIDATES}, {s_picks('cands')}
SELECT l.paper_id, CASE WHEN p.url IS NOT NULL OR r.url IS NOT NULL THEN 'rule' ELSE 'fallback-top1' END AS picked_by, coalesce(p.url, r.url, l.url) AS url,
  coalesce(p.anchor, r.anchor, l.anchor) AS why, coalesce(p.score, r.score, l.score) AS score, 0.0::DOUBLE AS confidence
FROM leader l LEFT JOIN preferred p USING (paper_id) LEFT JOIN ruled r USING (paper_id)""")
def o09(spark, sf):
    """Flagship: links of every page to one primary link per paper."""
    return primary_links(_occurrences(spark, sf), ["form", "pos"])


@query("o09_primary_link_hybrid", f"""WITH {S_SCORED}, {s_picks('scored')},
ext AS (SELECT paper_id, url, score FROM scored WHERE contains(anchor, 'code') QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY pos DESC) = 1)
SELECT l.paper_id, CASE WHEN p.url IS NOT NULL OR r.url IS NOT NULL THEN 'rule' WHEN e.url IS NOT NULL THEN 'llm' ELSE 'fallback-top1' END AS picked_by,
  coalesce(p.url, r.url, e.url, l.url) AS url, coalesce(p.score, r.score, e.score, l.score) AS score
FROM leader l LEFT JOIN preferred p USING (paper_id) LEFT JOIN ruled r USING (paper_id) LEFT JOIN ext e USING (paper_id)""")
def o09_hybrid(spark, sf):
    cands = _scored(spark, sf)
    external = cands.filter(F.col("anchor").contains("code")).select("paper_id", "url", F.lit("said so").alias("why"), (F.col("pos") / 100).alias("confidence"))
    return links.resolve_primary(cands, links.keep_listed(external, cands)).select("paper_id", "picked_by", "url", "score")


@query("o10_top_candidate", f"WITH {S_SCORED}, {s_picks('scored')} SELECT paper_id, url, score FROM leader")
def o10(spark, sf):
    top = links.leading_candidates(_scored(spark, sf), k=1).select("paper_id", F.get("top", 0).alias("p"))
    return top.select("paper_id", "p.url", "p.score")


@query("o11_audit", f"WITH {S_SCORED}, {s_picks('scored')} SELECT paper_id, CAST(rank AS INTEGER) AS rank, url, score FROM ord")
def o11(spark, sf):
    return links.ranked_candidates(_scored(spark, sf)).select("paper_id", "rank", "url", "score")


@query("o12_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 100")
def o12(spark, sf):
    return splits.seeded_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100)


# --- U: set operations -------------------------------------------------------------------------


@query("u01_source_union", """SELECT CAST(doc_id AS VARCHAR) AS id, text AS body, NULL::VARCHAR AS html, CAST(0 AS INTEGER) AS src FROM documents UNION ALL
SELECT CAST(item_id AS VARCHAR), text, NULL, 1 FROM benchmark UNION ALL SELECT CAST(page_id AS VARCHAR), NULL, html, 2 FROM pages""")
def u01(spark, sf):
    def part(name, key, *cols):
        return table(spark, sf, name).select(F.col(key).cast("string").alias("id"), *cols)

    body = F.col("text").alias("body")
    return ledger.union_sources([part("documents", "doc_id", body), part("benchmark", "item_id", body), part("pages", "page_id", "html")]).select("id", "body", "html", "src")


def _tex_links(spark, sf):
    def text(x):
        form = x["pos"] % 3
        return (
            F.when(form == 0, F.concat(F.lit("\\href{"), x["url"], F.lit("}{here}")))
            .when(form == 1, F.concat(F.lit("\\url{"), x["url"], F.lit("}")))
            .otherwise(F.concat(F.lit("at "), x["url"], F.lit(").")))
        )

    rows = pages_with_links(spark, sf).filter(F.size("links") > 0)
    return rows.select("paper_id", F.array_join(F.transform("links", text), " \n ").alias("text"))


@query("u02_link_forms", f"""WITH {S_PAGE_LINKS}, d AS (SELECT DISTINCT paper_id, trim(url, ').,;]') AS url FROM page_links)
SELECT paper_id, count(*) AS n, string_agg(url, ' ' ORDER BY url) AS links FROM d GROUP BY paper_id""")
def u02(spark, sf):
    return _tex_links(spark, sf).select("paper_id", urls.link_forms(F.col("text")).alias("l")).select(
        "paper_id", F.size("l").cast("long").alias("n"), F.array_join("l", " ").alias("links")
    )


@query("u03_relevant_links", """SELECT item_id, array_to_string(list_sort(list_distinct(CASE item_id % 3 WHEN 0 THEN ['p' || item_id, 'd' || item_id, 'x', 'm'] WHEN 1 THEN ['one' || item_id] ELSE ['m', 'n', 't' || item_id] END)), '|') AS links FROM benchmark""")
def u03(spark, sf):
    i, n = F.col("item_id") % 3, F.col("item_id").cast("string")
    truth = F.when(i == 0, F.concat(F.lit('{"paper_link": " p'), n, F.lit('", "dataset_link": "d'), n, F.lit('", "link": " ", "positives": ["x", "p'), n, F.lit('", ""]}'))).otherwise("a name")
    meta = F.when(i == 0, '{"positives": "m"}').when(i == 2, '{"positives": ["m", "n"]}')
    positives = F.when(i == 1, F.concat(F.lit("one"), n)).when(i == 2, F.concat(F.lit('["t'), n, F.lit('"]')))
    found = retrieval.relevant_links(truth, meta, F.lit(None).cast("string"), positives)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(found), "|").alias("links"))


@query("u04_url_union", f"WITH {S_PAGE_LINKS}, d AS (SELECT DISTINCT paper_id, url FROM page_links WHERE contains(anchor, 'dataset') OR contains(url, 'github')) SELECT paper_id, count(*) AS n, md5(string_agg(url, ' ' ORDER BY url)) AS digest FROM d GROUP BY 1")
def u04(spark, sf):
    def chosen(test):
        return F.transform(F.filter("links", test), lambda x: x["url"])

    both = F.array_sort(F.array_union(chosen(lambda x: x["anchor"].contains("dataset")), chosen(lambda x: x["url"].contains("github"))))
    rows = pages_with_links(spark, sf).filter(F.size(both) > 0)
    return rows.select("paper_id", F.size(both).cast("long").alias("n"), F.md5(F.array_join(both, " ")).alias("digest"))


@query("u05_lossless", f"""WITH {S_SHARDED}, lost AS (SELECT paper_name, section, pos, sha1(text) AS digest FROM sents WHERE length(text) > 200)
SELECT paper_name, section, pos, digest, count(*) AS difference FROM lost GROUP BY 1, 2, 3, 4""")
def u05(spark, sf):
    """Shards against the original; long sentences are left out of the shards on purpose and must be reported."""
    keys = ["paper_name", "section", "pos"]
    original = sentences.explode_sentences(corpus_items(spark, sf)).withColumn("digest", F.sha1("text"))
    shards = sentences.explode_sentences(_sharded(spark, sf)).filter(F.length("text") <= 200).withColumn("digest", F.sha1("text"))
    return splits.multiset_difference(original, shards, [*keys, "digest"])


@query("u06_seen_union", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type IN ('purchase', 'error')")
def u06(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), "event_type")
    return filters.seen_ids(e.filter("event_type = 'purchase'").unionByName(e.filter("event_type = 'error'")))
