"""Readers for landed JSON and text files. Schemas are fixed; nothing is inferred."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperlode import rules, schemas
from paperlode.functions.basic import blank_to_null, strip
from paperlode.functions.urls import (
    best_link,
    id_from_ledger_link,
    id_from_name,
    pdf_link_from_id,
)
from paperlode.operators.ledger import normalise_fields
from paperlode.operators.ranks import first_rows
from paperlode.sources.json_arrays import json_records

def _file() -> Column:
    return F.col("_metadata.file_path")


def read_papers(spark: SparkSession, path: str, schema: str = schemas.PAPER) -> DataFrame:
    """Record arrays below ``<day>/<category>.json``; day and category come from the path."""
    rows = json_records(spark, path, schema)
    folder = F.split("file", "/")
    day, name = (F.url_decode(F.element_at(folder, -1 - up)) for up in (1, 0))
    return rows.select(*_names(schema), day.alias("day"), F.regexp_replace(name, r"\.json$", "").alias("category"))


def _names(schema: str) -> list[str]:
    return [f"`{f.name}`" for f in StructType.fromDDL(schema).fields]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus items with their file and position in the file.

    ``global_sentence_ids`` orders them into the sentences of each paper.
    """
    return json_records(spark, path, schemas.CORPUS_FIELDS, numbered=True).withColumnRenamed("place", "item_pos")


def read_training_shards(spark: SparkSession, pattern: str, schema: str = schemas.GATE_SAMPLE) -> DataFrame:
    """Samples of all shards that match; a shard is an array of samples or ``{"data": [...]}``."""
    return json_records(spark, pattern, schema).withColumnRenamed("place", "pos")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries with their variant fields kept as JSON text."""
    return json_records(spark, path, schemas.QUERY).drop("file", "place")


def table_statistics(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Row counts and field names of both tables."""
    parts = [("queries", queries), ("records", records)]
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(",".join(df.columns)).alias("fields")
        )
        for name, df in parts
    ]
    return rows[0].unionByName(rows[1])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files (arrays of records); unreadable files are skipped."""
    return json_records(spark, path, schemas.LEDGER, whole_files=True).select(*_names(schemas.LEDGER), "file")


def result_index(ledger: DataFrame, order: list[str]) -> DataFrame:
    """Search index: records with both links, the first per raw pair."""
    paper, link = (strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in ("Paper Link", "Dataset Link"))
    keyed = ledger.withColumns({"__p": paper, "__d": link}).filter((F.col("__p") != "") & (F.col("__d") != ""))
    return first_rows(keyed, ["__p", "__d"], [F.col(c) for c in order]).drop("__p", "__d")


def parse_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """Ledger records of whole-file texts: a list, one record, or ``{"data": [...]}``.

    Only records whose paper link carries a versioned id stay; unreadable texts give nothing.
    """
    fields = ", ".join(f"`{n}`: STRING" for n in rules.LEDGER_FIELDS)
    record = f"STRUCT<{fields}>"
    c = F.col(text)
    as_list = F.from_json(c, f"ARRAY<{record}>")
    single = F.from_json(c, record)
    wrapped = F.from_json(c, f"data ARRAY<{record}>")["data"]
    first_char = F.left(strip(c), F.lit(1))
    has_field = F.lit(False)
    for name in rules.LEDGER_FIELDS:
        has_field = has_field | F.get_json_object(c, f"$['{name}']").isNotNull()
    entries = F.when(first_char == "[", as_list).otherwise(F.when(has_field, F.array(single)).otherwise(wrapped))
    keep = [n for n in texts.columns if n != text]
    rows = texts.select(*keep, F.posexplode(entries).alias("pos", "e")).select(*keep, "pos", "e.*")
    return normalise_fields(rows).filter(id_from_ledger_link(F.col("Paper Link")).isNotNull())


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text with path, name and time of change."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return raw.select(
        _file().alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("value").alias("text"),
    )


def _mtime_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def partial_entries(files: DataFrame) -> DataFrame:
    """Ledger rows of ``<id>.partial.json`` files (columns name, mtime, text).

    The id comes from the body or the name; the abstract stands in for a missing description; the time
    is updated, published or the time of change.
    """
    rows = files.withColumn("__id", F.regexp_extract("name", rules.PARTIAL_NAME_PATTERN, 1)).filter("__id <> ''")
    p = F.from_json("text", schemas.PARTIAL)
    parsed = rows.withColumn("p", p).filter(F.col("p").isNotNull())
    paper_id = F.coalesce(F.when(F.col("p.arxiv_id") != "", F.col("p.arxiv_id")), F.col("__id"))
    return parsed.select(
        F.coalesce(blank_to_null(F.col("p.paper_link_pdf")), pdf_link_from_id(paper_id)).alias("Paper Link"),
        best_link(F.array("p.dataset_description", "p.abstract")).alias("Dataset Link"),
        F.coalesce(
            blank_to_null(F.col("p.dataset_description")), strip(F.coalesce("p.abstract", F.lit("")))
        ).alias("Dataset Description"),
        F.coalesce(
            blank_to_null(F.col("p.updated")), blank_to_null(F.col("p.published")), _mtime_text(F.col("mtime"))
        ).alias("Timestamp"),
    )


def artefact_entries(files: DataFrame) -> DataFrame:
    """One ledger row per paper id from its files (columns folder, name, mtime, text).

    Texts come from ``.json``, ``.bert.desc.txt`` and ``.txt``; the time is that of the first file in
    the order json, pdf, desc, txt. At most four small values per paper are grouped.
    """
    ending = F.regexp_extract("name", r"^\d{4}\.\d+v\d+\.(json|pdf|bert\.desc\.txt|txt)$", 1)
    rows = files.withColumn("id", id_from_name(F.col("name"))).filter("id is not null").withColumn("kind", ending)

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    papers = rows.groupBy("folder", "id").agg(
        of("json", "text").alias("json"),
        strip(F.coalesce(of("bert.desc.txt", "text"), F.lit(""))).alias("desc"),
        strip(F.coalesce(of("txt", "text"), F.lit(""))).alias("txt"),
        F.coalesce(*[of(k, "mtime") for k in ("json", "pdf", "bert.desc.txt", "txt")]).alias("mtime"),
    )
    data = F.from_json("json", schemas.CORPUS_FILE)["data"]
    inner = F.flatten(F.transform(
        data,
        lambda i: F.concat(
            F.array(i["full_text"]),
            F.coalesce(F.transform(i["sentences"], lambda s: s["text"]), F.array().cast("array<string>")),
        ),
    ))
    texts = F.concat(F.coalesce(inner, F.array().cast("array<string>")), F.array("desc", "txt"))
    return papers.select(
        pdf_link_from_id(F.col("id")).alias("Paper Link"),
        best_link(texts).alias("Dataset Link"),
        F.col("desc").alias("Dataset Description"),
        F.coalesce(_mtime_text(F.col("mtime")), F.lit("")).alias("Timestamp"),
    )
