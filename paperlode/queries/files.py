"""Queries of the sources and sinks (S). Landed files are written from the driver tables first."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode import rules, schemas
from paperlode.functions import dates
from paperlode.functions.text import split_sentences
from paperlode.operators import quality, retrieval, sentences
from paperlode.queries.base import (
    S_PAPERS,
    papers,
    query,
    s_sentences,
    s_squeeze,
    s_strip,
    table,
)
from paperlode.queries.rows import S_METRICS, PDF, _ranked, _records, _truth
from paperlode.session import new_work_dir, staged
from paperlode.sources import archives, json_files, logs, markup, sinks

BLOCK = 64


def _land(rows: DataFrame, path: str, text: str = "value", part: str = "shard") -> str:
    """Write one text per part, as a file of its own."""
    rows.select(part, text).repartition(part).write.partitionBy(part).text(path)
    return path


def _shard(key: str = "doc_id") -> Column:
    return F.floor(F.col(key) / BLOCK)


# --- JSON --------------------------------------------------------------------------------------


@query("s01_read_papers", f"WITH {S_PAPERS} SELECT id, title, abstract, updated, published, '{PDF}' || id || '.pdf' AS pdf_link, left(updated, 4) AS day, category FROM papers")
def s01(spark, sf):
    """One array per day and category, read by byte ranges."""
    return json_files.read_papers(spark, _land_papers(spark, sf))


def _land_papers(spark, sf) -> str:
    """Files ``<day>/<category>.json``: written in folders of that name, then put in their places."""
    rows = papers(spark, sf).withColumn("pdf_link", F.concat(F.lit(PDF), F.col("id"), F.lit(".pdf"))).withColumn("day", F.left("updated", F.lit(4)))
    record = F.struct("id", "title", "abstract", "updated", "published", "pdf_link")
    arrays = rows.groupBy("day", "category").agg(F.collect_list(record).alias("r")).select("day", "category", F.to_json("r").alias("value"))
    path = new_work_dir(spark, "papers")
    arrays.repartition("day", "category").write.partitionBy("day", "category").text(path + "/written")
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in files.globStatus(made(path + "/written/day=*/category=*/part-*")):
        folder = part.getPath().getParent()
        day, category = folder.getParent().getName().removeprefix("day="), folder.getName().removeprefix("category=")
        files.mkdirs(made(f"{path}/landed/{day}"))
        files.rename(part.getPath(), made(f"{path}/landed/{day}/{category}.json"))
    return path + "/landed"


@query("s01_metadata_sink", f"WITH {S_PAPERS} SELECT id, title, abstract, updated, published, '{PDF}' || id || '.pdf' AS pdf_link, left(updated, 4) AS day, category FROM papers")
def s01_sink(spark, sf):
    path = new_work_dir(spark, "papers")
    rows = papers(spark, sf).withColumn("pdf_link", F.concat(F.lit(PDF), F.col("id"), F.lit(".pdf"))).withColumn("day", F.left("updated", F.lit(4)))
    sinks.write_metadata(rows.drop("pos"), path)
    return sinks.read_metadata(spark, path, schemas.PAPER)


def _land_corpus(spark, sf):
    """Corpus files of a block of documents each; the language is the paper, so names repeat."""
    d = table(spark, sf, "documents")
    sentence = F.transform(
        split_sentences(F.col("text")), lambda t, i: F.struct(i.cast("int").alias("sentence_id"), t.alias("text"), F.lit(0).alias("label"))
    )
    item = F.struct(
        F.col("doc_id"), F.col("lang").alias("paper_name"), F.col("source").alias("section"), F.col("doc_id").cast("int").alias("paragraph_id"),
        F.col("text").alias("full_text"), sentence.alias("sentences"),
    )
    blocks = d.select(_shard().alias("shard"), item.alias("i")).groupBy("shard").agg(F.array_sort(F.collect_list("i")).alias("data"))
    return _land(blocks.select("shard", F.to_json(F.struct("data")).alias("value")), new_work_dir(spark, "corpus"))


@query("s02_read_corpus", f"""WITH s AS (SELECT lang, source, doc_id, {s_sentences('text')} AS s FROM documents),
r AS (SELECT lang, source, doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS i FROM s)
SELECT lang AS paper_name, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id, i) - 1 AS gid, text FROM r""")
def s02(spark, sf):
    items = json_files.read_corpus(spark, _land_corpus(spark, sf))
    return sentences.global_sentence_ids(items).select("paper_name", "gid", "text")


@query("s03_consecutive_groups", f"""WITH p AS (SELECT doc_id, doc_id // {BLOCK} AS shard, lang, CAST(coalesce(lag(lang) OVER (PARTITION BY doc_id // {BLOCK} ORDER BY doc_id) <> lang, TRUE) AS INTEGER) AS starts FROM documents)
SELECT doc_id AS paragraph_id, lang AS paper_name, CAST(sum(starts) OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS group_no FROM p""")
def s03(spark, sf):
    # Items meet the item before them and the runs of their block: what that needs is read from the files once.
    items = json_files.read_corpus(spark, _land_corpus(spark, sf)).select("file", "item_pos", "paragraph_id", "paper_name")
    found = sentences.consecutive_groups(staged(items, "items"))
    return found.select(F.col("paragraph_id").cast("long").alias("paragraph_id"), "paper_name", "group_no")


@query("s04_training_shards", "SELECT source AS title, text AS abstract, CAST(doc_id % 2 AS INTEGER) AS label FROM documents")
def s04(spark, sf):
    d = table(spark, sf, "documents")
    sample = F.struct(F.col("source").alias("title"), F.col("text").alias("abstract"), (F.col("doc_id") % 2).alias("label"))
    blocks = d.select(_shard().alias("shard"), sample.alias("s")).groupBy("shard").agg(F.collect_list("s").alias("data"))
    value = F.when(F.col("shard") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data")))
    path = _land(blocks.select("shard", value.alias("value")), new_work_dir(spark, "training"))
    return json_files.read_training_shards(spark, path + "/*").select("title", "abstract", "label")


@query("s05_lookup", "SELECT 'https://' || source || '.org' AS link, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY 1 HAVING count(*) > 0")
def s05(spark, sf):
    """Lookup by link returns one record; how many share its link is counted over the whole table."""
    records = _records(spark, sf)
    one = retrieval.find_by_link(records, "https://src3.org").select(F.col("Dataset Link").alias("link"))
    return records.select(F.col("Dataset Link").alias("link")).join(one, "link").groupBy("link").agg(F.count(F.lit(1)).alias("n"))


@query("s05_table_statistics", """SELECT 'queries' AS "table", count(*) AS rows, 'item_id,text' AS fields FROM benchmark UNION ALL
SELECT 'records', count(*), 'doc_id,text,lang,source,n_chars' FROM documents""")
def s05_statistics(spark, sf):
    return json_files.table_statistics(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query("s05_read_tables", f"""SELECT item_id % 3 = 0 AS listed, md5(text) AS digest, CASE WHEN item_id % 2 = 0 THEN '["p' || item_id || '"]' ELSE 'p' || item_id END AS positives,
  (SELECT count(*) FROM documents WHERE doc_id % 4 <> 3) AS records FROM benchmark""")
def s05_tables(spark, sf):
    """Queries with variant fields from landed arrays, beside the number of usable records of the landed ledger."""
    n = F.col("item_id").cast("string")
    plain = F.struct(F.col("text").alias("query"), F.concat(F.lit("p"), n).alias("positives"), F.when(F.col("item_id") % 3 == 0, "yes").alias("instruction"))
    listed = F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("p"), n)).alias("positives"), F.when(F.col("item_id") % 3 == 0, "yes").alias("instruction"))
    one = F.when(F.col("item_id") % 2 == 0, F.to_json(listed)).otherwise(F.to_json(plain))
    rows = table(spark, sf, "benchmark").select((F.col("item_id") % 5).alias("shard"), one.alias("v")).groupBy("shard").agg(F.collect_list("v").alias("vs"))
    files = rows.select("shard", F.concat(F.lit("["), F.array_join("vs", ", "), F.lit("]")).alias("value"))
    queries = json_files.read_queries(spark, _land(files, new_work_dir(spark, "queries")))
    usable = json_files.read_ledger(spark, _land_ledger(spark, sf)).filter("trim(`Dataset Link`) <> ''").count()
    return queries.select(
        (F.coalesce("instruction", F.lit("")) == "yes").alias("listed"), F.md5("query").alias("digest"), "positives", F.lit(usable).cast("bigint").alias("records")
    )


def _land_ledger(spark, sf) -> str:
    rows = _ledger_rows(spark, sf)
    fields = F.struct(*[f"`{c}`" for c in ("Paper Link", "Dataset Link", "Dataset Description", "Timestamp")])
    blocks = rows.groupBy("shard").agg(F.collect_list(fields).alias("r")).select("shard", F.to_json("r").alias("value"))
    return _land(blocks, new_work_dir(spark, "ledger"))


def _ledger_rows(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        _shard().alias("shard"), "doc_id",
        F.concat(F.lit(PDF), F.floor(F.col("doc_id") / 4).cast("string")).alias("Paper Link"),
        F.when(F.col("doc_id") % 4 == 3, " ").otherwise(F.concat(F.lit(" d"), (F.col("doc_id") % 2).cast("string"))).alias("Dataset Link"),
        F.col("text").alias("Dataset Description"), F.col("doc_id").cast("string").alias("Timestamp"),
    )


@query("s06_result_index", f"""SELECT '{PDF}' || doc_id // 4 AS "Paper Link", doc_id AS pos, text AS "Dataset Description" FROM documents WHERE doc_id % 4 <> 3
QUALIFY row_number() OVER (PARTITION BY doc_id // 4, doc_id % 2 ORDER BY doc_id) = 1""")
def s06(spark, sf):
    ledger = json_files.read_ledger(spark, _land_ledger(spark, sf))
    found = json_files.result_index(ledger.withColumn("pos", F.col("Timestamp").cast("long")), ["pos"])
    return found.select("Paper Link", "pos", "Dataset Description")


@query("s07_parse_entries", f"""SELECT doc_id, '{PDF}2401.' || doc_id || 'v1.pdf' AS "Paper Link", text AS "Dataset Description", '' AS "Timestamp" FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, '{PDF}2402.' || doc_id || 'v2.pdf', '', 'now' FROM documents WHERE doc_id % 4 IN (0, 1)""")
def s07(spark, sf):
    """A list, a wrapped list, one record, or broken text per file."""
    n = F.col("doc_id").cast("string")
    one = F.to_json(F.struct(F.concat(F.lit(PDF + "2401."), n, F.lit("v1.pdf")).alias("Paper Link"), F.col("text").alias("Dataset Description")))
    two = F.to_json(F.struct(F.concat(F.lit(PDF + "2402."), n, F.lit("v2.pdf")).alias("Paper Link"), F.lit("now").alias("Timestamp")))
    none = F.to_json(F.struct(F.concat(F.lit(PDF + "2401."), n).alias("Paper Link")))
    both = F.concat(F.lit("["), one, F.lit(","), none, F.lit(","), two, F.lit("]"))
    shape = F.col("doc_id") % 4
    value = F.when(shape == 0, both).when(shape == 1, F.concat(F.lit('{"data": '), both, F.lit("}"))).when(shape == 2, one).otherwise(F.left(both, F.length(both) - 9))
    texts = table(spark, sf, "documents").select("doc_id", value.alias("text"))
    return json_files.parse_entries(texts).select("doc_id", "Paper Link", "Dataset Description", "Timestamp")


@query("s08_partial_entries", f"""SELECT '{PDF}' || CASE WHEN doc_id % 2 = 0 THEN 'b' || doc_id ELSE '2401.' || doc_id || 'v1' END || '.pdf' AS "Paper Link",
  'https://zenodo.org/record/' || doc_id AS "Dataset Link", {s_strip("CASE WHEN doc_id % 3 = 0 THEN 'see https://zenodo.org/record/' || doc_id || ', ok' ELSE text || ' https://zenodo.org/record/' || doc_id || '.' END")} AS "Dataset Description",
  CASE WHEN doc_id % 5 = 0 THEN 'pub' WHEN doc_id % 5 = 1 THEN '2024-05-01T00:00:00Z' ELSE 'upd' END AS "Timestamp" FROM documents WHERE doc_id % 7 <> 0""")
def s08(spark, sf):
    n = F.col("doc_id").cast("string")
    link = F.concat(F.lit("https://zenodo.org/record/"), n)
    i = F.col("doc_id")
    body = F.struct(
        F.when(i % 2 == 0, F.concat(F.lit("b"), n)).otherwise("").alias("arxiv_id"),
        F.when(i % 3 != 0, F.concat("text", F.lit(" "), link, F.lit("."))).alias("dataset_description"),
        F.concat(F.lit("see "), link, F.lit(", ok")).alias("abstract"),
        F.when(i % 5 > 1, "upd").alias("updated"), F.when(i % 5 == 0, "pub").alias("published"),
    )
    name = F.concat(F.lit("2401."), n, F.when(i % 7 == 0, F.lit(".partial.json")).otherwise("v1.partial.json"))
    files = table(spark, sf, "documents").select(
        name.alias("name"), F.lit("2024-05-01 00:00:00").cast("timestamp").alias("mtime"), F.to_json(body).alias("text")
    )
    return json_files.partial_entries(files)


@query("s09_artefact_entries", f"""WITH g AS (SELECT doc_id // 3 AS g, max(CASE WHEN doc_id % 3 = 0 THEN text END) AS a, max(CASE WHEN doc_id % 3 = 1 THEN text END) AS b, max(CASE WHEN doc_id % 3 = 2 THEN text END) AS c FROM documents GROUP BY 1)
SELECT '{PDF}2401.' || g || 'v1.pdf' AS "Paper Link", CASE WHEN a IS NOT NULL THEN 'https://osf.io/' || g ELSE '' END AS "Dataset Link", coalesce({s_strip('b')}, '') AS "Dataset Description",
  CASE WHEN a IS NOT NULL THEN '2024-05-01T00:00:00Z' WHEN b IS NOT NULL THEN '2024-05-02T00:00:00Z' ELSE '2024-05-03T00:00:00Z' END AS "Timestamp" FROM g""")
def s09(spark, sf):
    i = F.col("doc_id") % 3
    group = F.floor(F.col("doc_id") / 3).cast("string")
    corpus = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.col("text"), F.lit(" https://example.org/"), group).alias("full_text"),
        F.array(F.struct(F.concat(F.lit("At https://osf.io/"), group, F.lit(".")).alias("text"))).alias("sentences"),
    )).alias("data")))
    ending = F.when(i == 0, ".json").when(i == 1, ".bert.desc.txt").otherwise(".txt")
    day = F.concat(F.lit("2024-05-0"), (i + 1).cast("string"), F.lit(" 00:00:00")).cast("timestamp")
    files = table(spark, sf, "documents").select(
        F.lit("d/c").alias("folder"), F.concat(F.lit("2401."), group, F.lit("v1"), ending).alias("name"), day.alias("mtime"),
        F.when(i == 0, corpus).otherwise(F.col("text")).alias("text"),
    )
    return json_files.artefact_entries(files)


# --- feeds, pages, full text -------------------------------------------------------------------


def _escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


@query("s10_read_feed", f"""SELECT '2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v1' AS id, source AS title, {s_strip('text')} AS abstract, '2024-01-02T03:04:05Z' AS updated, '' AS published,
  '{PDF}2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v1.pdf' AS pdf_link FROM documents""")
def s10(spark, sf):
    number = F.lpad(F.col("doc_id").cast("string"), 5, "0")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), number, F.lit("v1</id><title> "), "source", F.lit("</title><summary>"), _escape(F.col("text")),
        F.lit('</summary><updated>2024-01-02T03:04:05Z</updated><link href="http://x.org/a.pdf" type="application/pdf"/></entry>'),
    )
    rows = table(spark, sf, "documents").select(_shard().alias("shard"), entry.alias("e")).groupBy("shard").agg(F.collect_list("e").alias("es"))
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join("es", "\n"), F.lit("</feed>"))
    return markup.read_feed(spark, _land(rows.select("shard", feed.alias("value")), new_work_dir(spark, "feed"))).drop("file")


def _listing(spark, sf):
    """Listing pages of 25 documents each."""
    n = F.col("doc_id").cast("string")
    full = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<a href="https://arxiv.org/html/'), n, F.lit('" title="View HTML">html</a>'))).otherwise("")
    dt = F.concat(F.lit('<dt><a href ="/abs/'), n, F.lit('" title="Abstract" id="x">a</a> <a href="/pdf/'), n, F.lit('" title="Download PDF">pdf</a>'), full, F.lit("</dt><dd>"), "source", F.lit("</dd>\n"))
    dt = F.replace(dt, F.lit("href ="), F.lit("href="))
    page = F.floor(F.col("doc_id") / 25)
    rows = table(spark, sf, "documents").select(page.alias("page"), F.struct("doc_id", dt.alias("dt")).alias("d")).groupBy("page").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    said = F.when(F.col("page") % 2 == 0, F.concat(F.lit(" (showing "), F.size("ds").cast("string"), F.lit("&nbsp;of 99 entries )"))).otherwise("")
    head = F.concat(F.lit("<p>Total of 1"), F.col("page").cast("string"), F.lit(" entries</p><h3>Wed, 3 Sep 2025</h3><dl><dt>old</dt></dl><h3>Thu,&nbsp;4  Sep 2025"), said, F.lit("</h3>\n<dl>"))
    return rows.select("page", F.size("ds").alias("n"), F.concat(head, F.array_join(F.transform("ds", lambda d: d["dt"]), ""), F.lit("</dl><h3>Fri</h3><dl><dt>z</dt></dl>")).alias("html"))


@query("s11_listing_items", """SELECT doc_id // 25 AS page, '/abs/' || doc_id AS abs_url, CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/html/' || doc_id ELSE '/pdf/' || doc_id END AS url FROM documents""")
def s11(spark, sf):
    pages = _listing(spark, sf).select("page", F.regexp_replace("html", r"(?s)<dl><dt>old</dt></dl>|<h3>Fri.*", "").alias("html"))
    return markup.listing_items(pages).select("page", "abs_url", "url")


@query("s11_abstract_page", f"""SELECT doc_id, source AS title, {s_strip('text')} AS abstract, 'A. Uthor & Co' AS authors, CASE WHEN doc_id % 2 = 0 THEN '4 Sep 2025' ELSE 'N/A' END AS date,
  CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10/' || doc_id ELSE 'N/A' END AS doi FROM documents""")
def s11_page(spark, sf):
    n = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<h1 class="title mathjax"><span>Title:</span> '), "source", F.lit('</h1><div class="authors"><span>Authors:</span><a href="x">A. Uthor</a> &amp; Co</div><div class="dateline">'),
        F.when(F.col("doc_id") % 2 == 0, "[Submitted on 4 Sep 2025]").otherwise("none"), F.lit('</div><blockquote class="abstract mathjax"><span>Abstract:</span>'), _escape(F.col("text")), F.lit("</blockquote>"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<td class="tablecell arxivdoi"><a href="https://doi.org/10/'), n, F.lit('">x</a></td>'))).otherwise(""),
    )
    return markup.abstract_page(table(spark, sf, "documents").select("doc_id", html.alias("html")))


@query("s12_day_count", """SELECT doc_id // 25 AS page, CAST(CASE WHEN (doc_id // 25) % 2 = 0 THEN 99 ELSE count(*) END AS INTEGER) AS listed, CAST('1' || doc_id // 25 AS INTEGER) AS total FROM documents GROUP BY doc_id // 25""")
def s12(spark, sf):
    return _listing(spark, sf).select(
        "page", markup.day_count(F.col("html"), "Thu, 4 Sep 2025").alias("listed"), markup.total_entries(F.col("html")).alias("total")
    )


@query("s13_tei_sections", f"""WITH p AS (SELECT doc_id, lang, {s_strip("regexp_replace(text, '[^\\pL\\pN ,.!?\\n]', '', 'g')")} AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'About ' || lang END AS section,
  CASE WHEN doc_id % 4 = 3 THEN {s_squeeze('t')} ELSE t || ' Second' END AS full_text FROM p""")
def s13(spark, sf):
    plain = F.regexp_replace("text", r"[^\p{L}\p{N} ,.!?\n]", "")
    body = F.concat(F.lit("<div><head> About "), "lang", F.lit(" </head><p>"), plain, F.lit("<ref>[1]</ref> rest</p><p/><p>Second</p></div>"))
    content = F.when(F.col("doc_id") % 4 == 3, plain).otherwise(body)
    tei = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text>'), content, F.lit("</text></TEI>"))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(markup.tei_sections(tei)).alias("s"))
    return rows.select("doc_id", "s.section", "s.full_text")


@query("s13_tagged_text", f"""SELECT doc_id, '[TITLE]' || source || '[/TITLE]' || chr(10) || '[SECTION]' || lang || '[/SECTION]' || chr(10) || text || chr(10) AS tagged FROM documents""")
def s13_tagged(spark, sf):
    section = F.array(F.struct(F.col("lang").alias("section"), F.col("text").alias("full_text")))
    return table(spark, sf, "documents").select("doc_id", markup.tagged_text(F.col("source"), section).alias("tagged"))


# --- archives ----------------------------------------------------------------------------------


def _archives(spark, sf):
    """One tar archive per document: its text, a bibliography, a style file, a picture and an unsafe name."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for pdf in batches:
            # A few hundred archives at a time: a tar is several times its text.
            for at in range(0, len(pdf), 256):
                out = []
                for doc_id, text, source in pdf.iloc[at:at + 256].itertuples(index=False):
                    buffer = io.BytesIO()
                    with tarfile.open(fileobj=buffer, mode="w:gz" if doc_id % 2 else "w") as archive:
                        for name, data in (
                            ("main.tex", text), ("a/refs.bib", source), ("b.sty", "style"), ("fig.png", "x"), ("../up.tex", "bad"), ("/etc/a.tex", "bad"),
                        ):
                            raw = data.encode()
                            info = tarfile.TarInfo(name)
                            info.size = len(raw)
                            archive.addfile(info, io.BytesIO(raw))
                    out.append((doc_id, b"broken" if doc_id % 10 == 9 else buffer.getvalue()))
                yield pd.DataFrame(out, columns=["paper_id", "content"])

    return table(spark, sf, "documents").select("doc_id", "text", "source").mapInPandas(pack, "paper_id LONG, content BINARY")


@query("s14_expand_archives", """SELECT doc_id AS paper_id, 'main.tex' AS path, text FROM documents WHERE doc_id % 10 <> 9 UNION ALL SELECT doc_id, 'a/refs.bib', source FROM documents WHERE doc_id % 10 <> 9""")
def s14(spark, sf):
    return archives.expand_archives(_archives(spark, sf))


ARCHIVE_DOCUMENTS = 100


@query("s14_landed_archives", f"""WITH d AS (SELECT doc_id, CAST(floor(doc_id / {ARCHIVE_DOCUMENTS}) AS BIGINT) AS paper_id, coalesce(text, '') AS text FROM documents)
SELECT paper_id, 'd' || doc_id || '.tex' AS path, text, NULL AS reason FROM d WHERE paper_id % 10 <> 9
UNION ALL SELECT DISTINCT paper_id, NULL, NULL, 'broken' FROM d WHERE paper_id % 10 = 9""")
def s14_landed(spark, sf):
    """Archives of a block of documents each, landed as files; a tar of texts is text itself, so Spark's text sink writes it."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / ARCHIVE_DOCUMENTS).alias("paper_id"), F.coalesce("text", F.lit("")).alias("text")
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import tarfile

        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w", format=tarfile.GNU_FORMAT) as archive:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for name in (f"d{doc_id}.tex", f"../d{doc_id}.tex"):
                    raw = text.encode()
                    info = tarfile.TarInfo(name)
                    info.size = len(raw)
                    archive.addfile(info, io.BytesIO(raw))
        paper = int(pdf["paper_id"].iloc[0])
        value = "broken" if paper % 10 == 9 else buffer.getvalue().decode()
        return pd.DataFrame({"paper_id": [paper], "value": [value]})

    path = new_work_dir(spark, "archives")
    d.groupBy("paper_id").applyInPandas(pack, "paper_id LONG, value STRING").write.partitionBy("paper_id").text(path)
    paper = F.regexp_extract("path", r"paper_id=(\d+)/", 1).cast("bigint")
    members, rejects = archives.read_members(spark, path, paper_id=paper)
    no_text = F.lit(None).cast("string")
    return members.withColumn("reason", no_text).unionByName(rejects.select("paper_id", no_text.alias("path"), no_text.alias("text"), "reason"))


@query("s15_concatenate_sources", """SELECT doc_id AS paper_id, chr(10) || chr(10) || '===== b.sty =====' || chr(10) || 'style' || chr(10) || chr(10) || '===== main.tex =====' || chr(10) || text
  || chr(10) || chr(10) || '===== a/refs.bib =====' || chr(10) || source AS text FROM documents WHERE doc_id % 10 <> 9""")
def s15(spark, sf):
    return archives.concatenate_sources(archives.expand_archives(_archives(spark, sf), rules.SOURCE_MEMBERS))


# --- sinks -------------------------------------------------------------------------------------


@query("s16_partitioned_metadata", f"""WITH {S_PAPERS} SELECT left(updated, 4) AS day, category, count(*) AS n, min(id) AS first_id FROM papers
  WHERE NOT (left(updated, 4) = '2025' AND category IN ('cs.en', 'cs.de')) GROUP BY 1, 2""")
def s16(spark, sf):
    """Written three times: a write replaces its own partitions only, and empties those it covers without papers."""
    path = new_work_dir(spark, "metadata")
    rows = papers(spark, sf).drop("pos").withColumn("day", F.left("updated", F.lit(4)))
    sinks.write_metadata(rows, path)
    sinks.write_metadata(rows.filter("day < '2024'"), path)
    sinks.write_metadata(rows.filter("false"), path, [("2025", "cs.en"), ("2025", "cs.de")])
    found = sinks.read_metadata(spark, path, schemas.PAPER)
    return found.groupBy("day", "category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("s17_append_samples", "SELECT conv_id, turn, text AS input, CASE WHEN role = 'user' THEN 'other' ELSE 'dataset' END AS label, CAST(512 AS BIGINT) AS max_length FROM conversations")
def s17(spark, sf):
    c = table(spark, sf, "conversations")
    path = new_work_dir(spark, "samples")
    keys = ["conv_id", "turn"]
    labels = c.select(*keys, F.when(F.col("role") == "user", "other").otherwise("dataset").alias("label"))
    rows = sinks.link_samples(c.select(*keys, "role"), c.select(*keys, F.col("text").alias("input")), labels, keys, {"max_length": 512})
    rows = rows.withColumn("day", F.lit("2024-01-01")).withColumnRenamed("role", "category")
    for kind in ("user", "assistant"):
        sinks.append_samples(rows.filter(F.col("category") == kind), path)
    sinks.append_samples(rows.filter(~F.col("category").isin("user", "assistant")), path)
    schema = "conv_id LONG, turn LONG, input STRING, label STRING, max_length LONG"
    return sinks.read_samples(spark, path, schema).select("conv_id", "turn", "input", "label", "max_length")


@query("s18_write_csv", "SELECT o_orderpriority AS category, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders GROUP BY 1, 2")
def s18(spark, sf):
    path = new_work_dir(spark, "csv")
    o = table(spark, sf, "orders")
    sinks.write_csv(o.groupBy(F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("count")), path)
    return sinks.read_csv(spark, path, "category STRING, year INT, count LONG")


@query("s19_write_experiment", f"""WITH {S_METRICS}, l AS (UNPIVOT (SELECT * FROM m) ON {', '.join(retrieval.METRICS)} INTO NAME metric VALUE value)
SELECT 'given_without_instruction' AS experiment, metric, k, round(avg(value), 6) AS mean FROM l GROUP BY 2, 3""")
def s19(spark, sf):
    path = new_work_dir(spark, "experiment")
    # Written once: the scores and the saved rankings both read it.
    ranked = staged(_ranked(spark, sf), "rankings")
    scores = retrieval.mean_metrics(retrieval.ranking_metrics(ranked, _truth(spark, sf), [1, 3, 5, 10]))
    sinks.write_experiment(ranked, scores, path, "given_without_instruction")
    saved = sinks.read_experiment(spark, path, "score", "metric STRING, k INT, mean DOUBLE")
    return saved.select("experiment", "metric", "k", F.round("mean", 6).alias("mean"))


@query("s20_ledger_day", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '2025-01-01' ELSE strftime(ts, '%Y-%m-%d') END || '（7）' AS paper_day, '2025-01-01（7）' AS run_day FROM events""")
def s20(spark, sf):
    i, at = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    updated, published = F.when(i == 0, at).otherwise(""), F.when(i == 1, at).otherwise("")
    return table(spark, sf, "events").select(
        "event_id", dates.paper_day(updated, published, F.lit("2025-01-01"), 7).alias("paper_day"), dates.ledger_day("2025-01-01", 7).alias("run_day")
    )


@query("s21_training_text", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' [SEP] ' || text ELSE text END AS text, CAST(doc_id % 3 = 0 AS INTEGER) AS label FROM documents")
def s21(spark, sf):
    i = F.col("doc_id")
    label = (i % 3 == 0).cast("int")
    d = table(spark, sf, "documents")
    rows = d.select(
        "doc_id", F.when(i % 2 == 0, F.col("source")).alias("title"), F.col("text").alias("abstract"), "text",
        F.when(i % 5 == 0, label).alias("label"), label.alias("has_dataset"),
    )
    keyed = quality.training_text(rows.withColumn("text", F.col("abstract")), keep=["doc_id"])
    return keyed.select("doc_id", "text", "label")


_STAGES = [("grobid_ms", 300), ("latex_extract_ms", 100), ("latex_pick_primary_ms", 50), ("other", 10)]


@query("s22_stage_report", """WITH t AS (SELECT ['grobid_ms', 'latex_extract_ms', 'latex_pick_primary_ms', 'other'][event_id % 4 + 1] AS stage, [300, 100, 50, 10][event_id % 4 + 1] * CAST(floor(value) AS BIGINT) AS ms FROM events WHERE event_id % 5 <> 0)
SELECT stage, count(*) AS runs, round(avg(ms), 3) AS mean_ms, max(ms) AS max_ms, count(*) FILTER (ms > CASE stage WHEN 'grobid_ms' THEN 60000 WHEN 'latex_extract_ms' THEN 8000 WHEN 'latex_pick_primary_ms' THEN 3000 ELSE 1000000000 END) AS slow_runs FROM t GROUP BY stage""")
def s22(spark, sf):
    i = (F.col("event_id") % 4).cast("int")
    stage, unit = F.array(*[F.lit(s) for s, _ in _STAGES])[i], F.array(*[F.lit(u) for _, u in _STAGES])[i]
    ms = (unit * F.floor("value")).cast("string")
    line = F.concat(F.lit("2025-01-01 INFO [TIME]["), F.col("user_id").cast("string"), F.lit("] "), stage, F.lit(" = "), ms, F.lit(" ms"))
    noise = F.concat(F.lit("2025-01-01 INFO nothing "), F.col("props"))
    path = new_work_dir(spark, "logs")
    table(spark, sf, "events").select(F.when(F.col("event_id") % 5 == 0, noise).otherwise(line).alias("value")).write.text(path)
    return logs.stage_report(logs.stage_times(spark.read.text(path)))


@query("s22_coverage_lines", """WITH t AS (SELECT event_type AS category, count(*) AS total, count(*) FILTER (value >= 20) AS has, count(*) FILTER (value < 20 AND value >= 5) AS no, count(*) FILTER (value < 5) AS unknown FROM events GROUP BY 1)
SELECT *, round(100.0::DOUBLE * has / (total - unknown), 2) AS percent FROM t""")
def s22_coverage(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("value") >= 20).alias("h"), F.count_if((F.col("value") < 20) & (F.col("value") >= 5)).alias("n"), F.count_if(F.col("value") < 5).alias("u")
    )
    line = F.concat(
        F.lit("2025-10-21 INFO "), "event_type", F.lit("    total= "), F.col("t").cast("string"), F.lit("  HAS=  "), F.col("h").cast("string"),
        F.lit("  NO=   "), F.col("n").cast("string"), F.lit("  UNKNOWN=   "), F.col("u").cast("string"), F.lit("  coverage(effective)= x%"),
    )
    return logs.coverage_lines(c.select(line.alias("value")))
