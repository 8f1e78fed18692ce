"""Feeds, listing pages and tagged full text."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.functions.basic import squeeze, strip
from paperlode.functions.dates import submitted_on
from paperlode.functions.text import strip_tags
from paperlode.functions.urls import pdf_link_from_id

FEED_ENTRY = (
    "id STRING, title STRING, summary STRING, updated STRING, published STRING, "
    "link ARRAY<STRUCT<_href: STRING, _type: STRING>>"
)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed Atom feeds with the columns of a paper entry and their file."""
    raw = (
        spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(FEED_ENTRY).load(path)
    )

    def field(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit("")))

    entry_id = field("id")
    short = strip(F.when(entry_id.contains("/abs/"), F.substring_index(entry_id, "/abs/", -1)).otherwise(
        F.substring_index(entry_id, "/", -1)
    ))
    pdf = F.filter(
        F.coalesce("link", F.array().cast("array<struct<_href: string, _type: string>>")),
        lambda k: (F.coalesce(k["_type"], F.lit("")) == "application/pdf") | k["_href"].endswith(".pdf"),
    )
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        short.alias("id"),
        field("title").alias("title"),
        field("summary").alias("abstract"),
        field("updated").alias("updated"),
        field("published").alias("published"),
        F.when(short != "", pdf_link_from_id(short)).otherwise(F.coalesce(F.get(pdf, 0)["_href"], F.lit(""))).alias("pdf_link"),
    )


# --- listing pages -----------------------------------------------------------------------------


def unescape(c: Column) -> Column:
    """The five named entities and the blank one."""
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _inner(page: Column, tag: str, css: str) -> Column:
    """Plain text inside the first ``tag`` whose class starts with ``css``; empty if there is none."""
    raw = F.regexp_extract(page, rf'(?is)<{tag}[^>]*class="{css}[^"]*"[^>]*>(.*?)</{tag}>', 1)
    return strip(unescape(F.regexp_replace(raw, "<[^>]+>", "")))


def listing_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per item of a listing page: item, abstract url and full-text url (html before pdf)."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<dt[^>]*>(.*?)</dt>"), 1)
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, F.posexplode(items).alias("item", "dt"))

    def link(title: str) -> Column:
        forward = F.regexp_extract("dt", rf'(?is)<a[^>]*href="([^"]*)"[^>]*title="{title}"', 1)
        backward = F.regexp_extract("dt", rf'(?is)<a[^>]*title="{title}"[^>]*href="([^"]*)"', 1)
        return F.when(forward != "", forward).otherwise(backward)

    full = F.when(link("View HTML") != "", link("View HTML")).otherwise(link("Download PDF"))
    return rows.select(*keep, "item", link("Abstract").alias("abs_url"), full.alias("url")).filter("abs_url <> ''")


def abstract_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, abstract, authors, date and doi of abstract pages; missing date and doi give N/A."""
    page = F.col(html)
    doi = F.regexp_extract(page, r'(?is)<td[^>]*class="tablecell arxivdoi"[^>]*>.*?<a[^>]*href="([^"]*)"', 1)

    def clean(tag: str, css: str, label: str) -> Column:
        return strip(F.replace(_inner(page, tag, css), F.lit(label), F.lit("")))

    return pages.withColumns({
        "title": clean("h1", "title", "Title:"),
        "abstract": clean("blockquote", "abstract", "Abstract:"),
        "authors": clean("div", "authors", "Authors:"),
        "date": submitted_on(_inner(page, "div", "dateline")),
        "doi": F.when(doi != "", doi).otherwise("N/A"),
    }).drop(html)


def day_count(page: Column, heading: str) -> Column:
    """Items of one day on a listing page: the number in its heading, else the items below it; 0 if absent."""
    blocks = F.split(page, r"(?i)<h3[^>]*>")
    named = F.filter(
        F.transform(blocks, lambda b: F.struct(squeeze(strip_tags(unescape(F.regexp_extract(b, r"(?is)^(.*?)</h3>", 1)))).alias("head"), b.alias("body"))),
        lambda x: x["head"].startswith(heading),
    )
    block = F.get(named, 0)
    said = F.regexp_extract(block["head"], r"(?i)showing.*?(\d+)\s+entries", 1).try_cast("int")
    first_list = F.regexp_extract(block["body"], r"(?is)<dl[^>]*>(.*?)(?:</dl>|\z)", 1)
    listed = F.regexp_count(first_list, F.lit(r"(?i)<dt[\s>]"))
    return F.when(block.isNull(), 0).otherwise(F.coalesce(said, listed, F.lit(0)))


def total_entries(page: Column) -> Column:
    """N of "Total of N entries"; null if the page has no such text."""
    return F.regexp_extract(page, r"Total of\s+(\d+)\s+entries", 1).try_cast("int")


# --- full text ---------------------------------------------------------------------------------

#: Documents whose sections are held at once.
TEI_SLICE = 256
_SECTION = "array<struct<section: string, full_text: string>>"


def tei_sections(document: Column) -> Column:
    """Sections of TEI full text: the head and joined paragraphs of every div."""

    @F.pandas_udf(_SECTION)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return read_slices(batches)

    return read(document)


def read_slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sections of all documents in order, of a few at a time: Spark counts the rows, not the batches."""
    for batch in batches:
        for at in range(0, len(batch), TEI_SLICE):
            yield batch.iloc[at:at + TEI_SLICE].map(read_tei)


def read_tei(document: str | None) -> list[dict] | None:
    """Sections of one document; without any, its plain text as one untitled section."""
    import re
    from xml.etree import ElementTree

    if document is None:
        return None
    try:
        divisions = ElementTree.fromstring(document).findall(".//{*}div")
    except ElementTree.ParseError:
        return None
    out = []
    for div in divisions:
        head = div.find(".//{*}head")
        texts = [p.text.strip() for p in div.iterfind(".//{*}p") if p.text]
        if texts:
            title = (head.text or "").strip() if head is not None else ""
            out.append({"section": title, "full_text": " ".join(texts)})
    plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", document)).strip()
    return out or [{"section": "", "full_text": plain}]


def tagged_text(title: Column, sections: Column) -> Column:
    """Title and sections as one tagged text."""
    body = F.transform(
        sections,
        lambda s: F.concat(F.lit("[SECTION]"), s["section"], F.lit("[/SECTION]\n"), s["full_text"], F.lit("\n")),
    )
    return F.concat(F.lit("[TITLE]"), title, F.lit("[/TITLE]\n"), F.array_join(body, ""))
