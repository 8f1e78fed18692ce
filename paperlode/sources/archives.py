"""Source archives of papers."""

import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode import rules
from paperlode.session import staged


#: Text that is handed on at a time while an archive is read.
SLICE_BYTES = 16 << 20
TOO_LARGE, BROKEN = "too large", "broken"


def _files(spark: SparkSession, path: str, paper_id: Column | None) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(tar\.gz|tgz|tar|gz)$", "")
    return raw.withColumn("paper_id", name if paper_id is None else paper_id)


def read_archives(spark: SparkSession, path: str, limit: int = rules.ARCHIVE_LIMIT_BYTES, paper_id: Column | None = None) -> DataFrame:
    """Landed archives up to the size limit; larger ones are not even read. ``paper_id`` is made from the file's ``path``,
    by default its name."""
    return _files(spark, path, paper_id).filter(F.col("length") <= limit).select("paper_id", "content")


def read_members(
    spark: SparkSession, path: str, limit: int = rules.ARCHIVE_LIMIT_BYTES, endings: tuple = rules.TEXT_MEMBERS, paper_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Members of all landed archives, and the archives that gave none because they could not be read.

    Members are (paper_id, path, text); rejects are (paper_id, file, reason), the reason being ``too large`` or ``broken``.
    Archives are read once; a reject takes nothing from the others. An archive without text members is in neither,
    nor is a file without bytes, which Spark's listing leaves out.
    """
    files = _files(spark, path, paper_id)
    key_type = files.schema["paper_id"].dataType.simpleString()
    small = files.filter(F.col("length") <= limit).select("paper_id", F.col("path").alias("file"), "content")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for paper, file, content in zip(pdf["paper_id"], pdf["file"], pdf["content"], strict=True):
                if not is_whole(content):
                    yield pd.DataFrame([(paper, file, None, None, BROKEN)], columns=columns)
                    continue
                for rows in slices(members_of(content, endings)):
                    yield pd.DataFrame([(paper, file, *m, None) for m in rows], columns=columns)

    columns = ["paper_id", "file", "path", "text", "reason"]
    read = staged(small.mapInPandas(expand, f"paper_id {key_type}, file STRING, path STRING, text STRING, reason STRING"), "archives")
    # The size is known from the listing: the content of these files is never asked for.
    large = files.filter(F.col("length") > limit).select("paper_id", F.col("path").alias("file"), F.lit(TOO_LARGE).alias("reason"))
    rejects = read.filter("reason is not null").select("paper_id", "file", "reason").unionByName(large)
    return read.filter("reason is null").select("paper_id", "path", "text"), rejects


def expand_archives(archives: DataFrame, endings: tuple = rules.TEXT_MEMBERS) -> DataFrame:
    """One row per text member: (paper_id, path, text). Unsafe names and unreadable archives are left out."""
    key_type = archives.schema["paper_id"].dataType.simpleString()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            papers, contents = batch.columns
            for rows in slices(members(contents)):
                at, paths, texts = zip(*rows, strict=True)
                made = [papers.take(pa.array(at, pa.int32())), pa.array(paths, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=["paper_id", "path", "text"])

    def members(contents: pa.Array) -> Iterator[tuple[int, str, str]]:
        # One archive at a time leaves the batch: it is never held as bytes a second time.
        for k, held in enumerate(contents):
            content = held.as_py()
            if is_whole(content):
                for name, text in members_of(content, endings):
                    yield k, name, text

    return archives.select("paper_id", "content").mapInArrow(expand, f"paper_id {key_type}, path STRING, text STRING")


def is_whole(content: bytes) -> bool:
    """Whether an archive can be read to its end; nothing of it is kept meanwhile."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
            for member in archive:
                if member.isfile():
                    data = archive.extractfile(member)
                    while data.read(1 << 20):
                        pass
    except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError):
        return False
    return True


def members_of(content: bytes, endings: tuple) -> Iterator[tuple[str, str]]:
    """(name, text) of the text members of an archive that is whole, one at a time."""
    with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
        for member in archive:
            name = member.name
            safe = not name.startswith("/") and ".." not in name
            if safe and member.isfile() and name.lower().endswith(endings):
                yield name, archive.extractfile(member).read().decode("utf-8", "ignore")


def slices(members: Iterator[tuple], size: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    """Members, their text last, in lists of about ``size`` characters, so that long archives are never held as text."""
    rows, held = [], 0
    for member in members:
        rows.append(member)
        held += len(member[-1])
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def concatenate_sources(members: DataFrame) -> DataFrame:
    """All member texts of a paper in one text with a header each, by folder and name.

    One paper is at most one archive, so the size limit of the archives bounds the result.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.substring_index("path", "/", -1)
    kept = members.filter(F.lower("path").rlike(r"\.(tex|bib|md|txt|sty|cls)$"))
    ordered = F.array_sort(F.collect_list(F.struct(folder.alias("folder"), name.alias("name"), "path", "text")))
    part = F.transform(ordered, lambda m: F.concat(F.lit("\n\n===== "), m["path"], F.lit(" =====\n"), m["text"]))
    return kept.groupBy("paper_id").agg(F.array_join(part, "").alias("text"))
