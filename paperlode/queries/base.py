"""Registry and shared inputs of the registered queries.

Every query reads the driver tables as they are. Inputs the reference has and the tables lack (links,
LaTeX, answers of a model) are built from these tables by the same expression in Spark and in SQL.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.functions.text import split_sentences, strip_tags
from paperlode.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that checks it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables of long texts, with their keys: a small one comes as a single split.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, _TEXTS[name]) if name in _TEXTS else df


# --- SQL fragments -----------------------------------------------------------------------------

_BLANKS = "' ' || " + " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 160, 8195, 8201, 8239, 12288))


def s_strip(e: str) -> str:
    return f"trim({e}, {_BLANKS})"


def s_squeeze(e: str) -> str:
    return s_strip(f"regexp_replace({e}, '[\\s\\x{{0b}}\\x{{a0}}\\x{{2003}}\\x{{2009}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')")


def s_sentences(e: str) -> str:
    body = s_strip(f"replace({e}, chr(13), '')")
    marked = f"regexp_replace({body}, '([。！？.!?])\\s+', '\\1' || chr(1), 'g')"

    def clean(parts: str) -> str:
        return f"list_filter(list_transform({parts}, lambda p: {s_strip('p')}), lambda p: p <> '')"

    return (
        f"CASE WHEN contains({marked}, chr(1)) THEN {clean(f'string_split({marked}, chr(1))')} "
        f"ELSE {clean(f'string_split({body}, chr(10))')} END"
    )


def s_strip_tags(e: str) -> str:
    return s_squeeze(f"regexp_replace({e}, '<[^>]+>', ' ', 'g')")


def s_array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def s_any(e: str, parts: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(e, p.replace("'", "''")) for p in parts) + ")"


def s_round(e: str, digits: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE), {digits})"


# --- links of pages ----------------------------------------------------------------------------

HOSTS = [
    "huggingface.co/datasets", "zenodo.org/record", "github.com/org/repo/releases", "github.com/org/repo",
    "doi.org", "example.org", "drive.google.com", "kaggle.com/datasets",
]
ENDINGS = ["", ".zip", "/files/a.csv", "/?utm_source=x&b=2#top"]
WORDS = ["our dataset", "code", "we release", "benchmark"]
_ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def _cycle(values: list[str], i: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.pmod(i, F.lit(len(values))).cast("int")]


def link_array(page_id: Column, html: Column) -> Column:
    """Links of one page on hosts the rules know, in order: (pos, url, anchor)."""

    def link(a: Column, pos: Column) -> Column:
        ending = _cycle(ENDINGS, page_id * 3 + pos)
        return F.struct(
            pos.alias("pos"),
            F.concat(F.lit("https://"), _cycle(HOSTS, page_id + pos), F.regexp_extract(a, _ANCHOR, 1), ending).alias("url"),
            F.concat_ws(" ", F.regexp_extract(a, _ANCHOR, 2), _cycle(WORDS, page_id + pos)).alias("anchor"),
        )

    return F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), 0), link)


def pages_with_links(spark: SparkSession, sf: str, **extra: Column) -> DataFrame:
    """One row per page with its links in an array: (paper_id, links)."""
    pages = table(spark, sf, "pages")
    links = link_array(F.col("page_id"), F.col("html"))
    return pages.select(F.col("page_id").alias("paper_id"), links.alias("links"), *[c.alias(n) for n, c in extra.items()])


def page_links(spark: SparkSession, sf: str, **extra: Column) -> DataFrame:
    """One row per link: (paper_id, pos, url, anchor). ``extra`` is computed once per page."""
    rows = pages_with_links(spark, sf, **extra).select("paper_id", *extra, F.explode("links").alias("l"))
    return rows.select("paper_id", *extra, "l.*")


S_PAGE_LINKS = f"""
link_rows AS (
  SELECT page_id AS paper_id, html, unnest(regexp_extract_all(html, '{_ANCHOR}', 0)) AS a,
         generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 0), 1) - 1 AS pos
  FROM pages),
page_links AS (
  SELECT paper_id, CAST(pos AS INTEGER) AS pos, html,
         'https://' || {s_array(HOSTS)}[(paper_id + pos) % {len(HOSTS)} + 1] || regexp_extract(a, '{_ANCHOR}', 1)
           || {s_array(ENDINGS)}[(paper_id * 3 + pos) % {len(ENDINGS)} + 1] AS url,
         regexp_extract(a, '{_ANCHOR}', 2) || ' ' || {s_array(WORDS)}[(paper_id + pos) % {len(WORDS)} + 1] AS anchor
  FROM link_rows)"""


def page_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of every page as a source file with its links as href commands in their places: (paper_id, path, text)."""

    def piece(p: Column, i: Column) -> Column:
        link = F.get("links", i)
        command = F.concat(F.lit(" \\href{"), link["url"], F.lit("}{"), link["anchor"], F.lit("} "))
        return F.concat(strip_tags(p), F.when(i < F.size("links"), command).otherwise(F.lit("")))

    rows = pages_with_links(spark, sf, html=F.col("html"))
    text = F.array_join(F.transform(F.split("html", _ANCHOR), piece), "")
    return rows.select("paper_id", F.lit("main.tex").alias("path"), text.alias("text"))


# Sentences of the same texts, with the number of links in front of each; a link lies in the sentence its command starts in.
S_PAGE_SOURCES = S_PAGE_LINKS + f""",
page_urls AS (SELECT paper_id, list(url ORDER BY pos) AS us, list(anchor ORDER BY pos) AS ans FROM page_links GROUP BY 1),
page_pieces AS (SELECT page_id AS paper_id, us, ans, string_split_regex(html, '{_ANCHOR}') AS ps FROM pages JOIN page_urls ON page_id = paper_id),
page_sents AS (
  SELECT paper_id, {s_sentences("array_to_string(list_transform(range(1, len(ps) + 1), lambda i: " + s_strip_tags("ps[i]") + " || CASE WHEN i <= len(us) THEN ' \\href{' || us[i] || '}{' || ans[i] || '} ' ELSE '' END), '')")} AS ss
  FROM page_pieces),
sent_rows AS (SELECT paper_id, ss, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM page_sents),
sent_links AS (
  SELECT paper_id, ss, k, (length(s) - length(replace(s, '\\href{{', ''))) // 6 AS n,
         sum((length(s) - length(replace(s, '\\href{{', ''))) // 6) OVER (PARTITION BY paper_id ORDER BY k) AS upto
  FROM sent_rows),
page_windows AS (
  SELECT l.paper_id, pos, trim(url, ').]') AS url, anchor,
         list_concat(list_append(ss[greatest(1, k - 6):k - 1], '[URL_PIVOT] ' || anchor), ss[k + 1:k + 6]) AS ws
  FROM page_links AS l JOIN sent_links AS s ON l.paper_id = s.paper_id AND pos >= upto - n AND pos < upto)"""


# --- the sentence corpus of documents ----------------------------------------------------------


def corpus_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as paragraphs: the source is the paper, the language the section."""
    d = table(spark, sf, "documents")
    sentence = F.transform(
        split_sentences(F.col("text")),
        lambda t, i: F.struct(i.cast("int").alias("sentence_id"), t.alias("text"), (F.length(t) % 2).alias("label")),
    )
    return d.select(
        F.col("source").alias("paper_name"), F.col("lang").alias("section"), F.col("doc_id").cast("int").alias("paragraph_id"),
        sentence.alias("sentences"),
    )


S_SENTENCES = f"""
items AS (
  SELECT source AS paper_name, lang AS section, CAST(doc_id AS INTEGER) AS paragraph_id, {s_sentences('text')} AS s FROM documents),
sents AS (
  SELECT paper_name, section, paragraph_id, unnest(s) AS text, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos FROM items),
numbered AS (
  SELECT *, length(text) % 2 AS label, row_number() OVER (PARTITION BY paper_name ORDER BY section, paragraph_id, pos) - 1 AS gid
  FROM sents)"""


def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as its own paper: (paper_name, gid, text); the index needs no shuffle."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("gid", "text"))
    return d.select(F.col("doc_id").alias("paper_name"), F.col("gid").cast("long").alias("gid"), "text")


S_DOCUMENT_SENTENCES = f"""
doc_items AS (SELECT doc_id AS paper_name, {s_sentences('text')} AS s FROM documents),
doc_sents AS (
  SELECT paper_name, unnest(s) AS text, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS gid FROM doc_items)"""


# --- papers of documents -----------------------------------------------------------------------

def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as paper entries with repeated ids across categories."""
    d = table(spark, sf, "documents")
    number = F.lpad((F.floor(F.col("doc_id") / 3)).cast("string"), 5, "0")
    year = (F.lit(2014) + F.col("doc_id") % 14).cast("string")
    return d.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("2401."), number, F.lit("v1")).alias("id"),
        F.col("source").alias("title"),
        F.col("text").alias("abstract"),
        F.concat(F.lit("cs."), F.col("lang")).alias("category"),
        F.concat(year, F.lit("-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")).alias("published"),
        F.concat(year, F.lit("-06-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")).alias("updated"),
    )


S_PAPERS = """
papers AS (
  SELECT doc_id AS pos, '2401.' || lpad(CAST(doc_id // 3 AS VARCHAR), 5, '0') || 'v1' AS id, source AS title, text AS abstract,
         'cs.' || lang AS category,
         CAST(2014 + doc_id % 14 AS VARCHAR) || '-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z' AS published,
         CAST(2014 + doc_id % 14 AS VARCHAR) || '-06-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z' AS updated
  FROM documents)"""


# --- predictions -------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents with a made-up but fixed probability and gold label."""
    rows = document_sentences(spark, sf)
    n = F.length("text")
    return rows.select(
        "paper_name", F.col("gid").cast("int").alias("sentence_index"), "text",
        (n % 100 / 100.0).alias("prob"),
        (n % 100 >= 50).cast("int").alias("predicted_label"),
        F.when(n % 11 == 0, -100).otherwise((n % 3 == 0).cast("int")).alias("true_label"),
        F.greatest(n % 100 / 100.0, 1 - n % 100 / 100.0).alias("confidence"),
    )


S_PREDICTIONS = S_DOCUMENT_SENTENCES + """,
preds AS (
  SELECT paper_name, CAST(gid AS INTEGER) AS sentence_index, text, length(text) % 100 / 100.0 AS prob,
         CAST(length(text) % 100 >= 50 AS INTEGER) AS predicted_label,
         CASE WHEN length(text) % 11 = 0 THEN -100 ELSE CAST(length(text) % 3 = 0 AS INTEGER) END AS true_label,
         greatest(length(text) % 100 / 100.0, 1 - length(text) % 100 / 100.0) AS confidence
  FROM doc_sents)"""
