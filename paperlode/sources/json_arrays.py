"""Arrays of JSON records, read by many tasks a file.

A file is ``[{...}, ...]`` or ``{"data": [{...}, ...]}``. Spark's text source cuts it into splits behind closing braces (its line
separator here), so a split never begins inside an escape, but it may begin inside a string or a record.

Pass 1: every split but a file's first is scanned twice, as if it began outside and inside a string, and tells how depth and quotes change.
The changes of a file's splits, one small row each, are added up in order; that gives the state each split begins in.
Pass 2: with that state every split finds its records. What lies across a border comes as pieces, and only these are
brought together and joined. Records are parsed by Spark.

Cases: an empty file and an empty array have no records; elements that are no objects are left out; braces, quotes and
escapes inside strings are text; keys other than ``data`` of the outer object are left out; a file that ends early is marked
(``whole`` is false) and gives the records in front of the one it ends in or behind; a record must fit a cell.
"""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.session import staged

#: Splits of all files whose states are sent to the tasks: some 100 bytes each.
MAX_SPLITS = 2_000_000
KEY = "data"

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)


class Scanner:
    """Depth and quotes of JSON text that comes in parts; ``lists`` tells for each depth whether the array open there is the wanted one."""

    def __init__(self, quoted: bool = False, depth: int = 0, listed: bool = False):
        self.quoted, self.depth, self.key = quoted, depth, None
        self.lists: dict[int, bool] = {1: listed}
        self.least = depth

    def brackets(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(bracket, its place, depth outside of it) for every bracket that is not in a string; the state follows."""
        at = 0
        if self.quoted:
            closed = _REST.match(text)
            if closed is None:
                return
            at, self.quoted, self.key = closed.end(), False, None
        for m in _TOKEN.finditer(text, at):
            sign = text[m.start()]
            if sign == '"':
                if m[1]:
                    self.key = m[0][1:-1]
                else:
                    self.quoted = True
            elif sign in "[{":
                if sign == "[":
                    self.lists[self.depth] = self.key == KEY
                self.depth += 1
                yield sign, m.start(), self.depth - 1
            else:
                self.depth -= 1
                self.least = min(self.least, self.depth)
                self.lists[self.depth] = False
                yield sign, m.start(), self.depth


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The texts of each split, closing braces put back; splits come one after the other."""

    def rows():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

    import itertools

    for key, group in itertools.groupby(rows(), key=lambda r: r[:2]):
        yield key, (r[2] + "}" for r in group)


_CHANGE = "file STRING, begins LONG, first STRING, quoted ARRAY<BOOLEAN>, depth ARRAY<INT>, least ARRAY<INT>, depth_open ARRAY<INT>, lists ARRAY<MAP<INT,BOOLEAN>>"
_STATE = "file STRING, begins LONG, level INT, quoted BOOLEAN, depth INT, listed BOOLEAN, whole BOOLEAN, final BOOLEAN"


def _changes(batches):
    for (file, begins), texts in _by_split(batches):
        # A file does not begin inside a string: its first split is scanned once.
        both = [Scanner(), Scanner(quoted=True)] if begins else [Scanner()]
        for s in both:
            s.lists = {}
        first, last = "", [0] * len(both)
        for text in texts:
            first = first or text.lstrip("\ufeff \t\r\n")[:1]
            for k, s in enumerate(both):
                for _ in s.brackets(text[:-1]):
                    pass
                last[k] = s.depth
                for _ in s.brackets(text[-1]):
                    pass
        yield pa.RecordBatch.from_pylist([{
            "file": file, "begins": begins, "first": first, "quoted": [s.quoted for s in both], "depth": [s.depth for s in both],
            "least": [s.least for s in both], "depth_open": last, "lists": [list(s.lists.items()) for s in both],
        }], schema=pa.schema([
            ("file", pa.string()), ("begins", pa.int64()), ("first", pa.string()), ("quoted", pa.list_(pa.bool_())), ("depth", pa.list_(pa.int32())),
            ("least", pa.list_(pa.int32())), ("depth_open", pa.list_(pa.int32())), ("lists", pa.list_(pa.map_(pa.int32(), pa.bool_()))),
        ]))


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """The state at the beginning of each split of one file; rows are as many as splits."""
    rows = rows.sort_values("begins")
    level = 0 if rows["first"].iloc[0] == "[" else 1
    quoted, depth, listed, out = False, 0, False, []
    ended = 0
    for r in rows.itertuples():
        out.append((r.file, r.begins, level, quoted, depth, listed))
        k = int(quoted)
        here = dict(r.lists[k])
        ended = depth + int(r.depth_open[k])
        if 1 - depth in here:
            listed = bool(here[1 - depth])
        depth, quoted = depth + int(r.depth[k]), bool(r.quoted[k])
    # An array ends in front of the brace that was put back, an object with its own.
    whole = not quoted and (ended if level == 0 else depth) == 0
    rows = [(*o, whole, k == len(out) - 1) for k, o in enumerate(out)]
    return pd.DataFrame(rows, columns=["file", "begins", "level", "quoted", "depth", "listed", "whole", "final"])


_PIECE = pa.schema([("file", pa.string()), ("begins", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("text", pa.string()), ("whole", pa.bool_())])
_WHOLE, _OPENING, _BETWEEN, _CLOSING = range(4)


def _pieces(shared):
    def find(batches):
        for (file, begins), texts in _by_split(batches):
            level, quoted, depth, listed, whole, final = shared.value[file, begins]
            scanner = Scanner(quoted, depth, listed)
            open_, held, out, n = depth > level + 1 and (level == 0 or listed), [], [], 0
            inside = open_
            text = next(texts, None)
            while text is not None:
                following = next(texts, None)
                # No record of a whole file ends with the file's last part: there the brace put back is not to be trusted.
                closes = len(text) - (final and following is None)
                start = 0
                for sign, at, outside in scanner.brackets(text[:closes]):
                    if outside != level + 1 or sign in "[]":
                        continue
                    if sign == "{" and (level == 0 or scanner.lists.get(1, False)):
                        start, open_, held = at, True, []
                    elif sign == "}" and open_:
                        held.append(text[start:at + 1])
                        # Records that begin here are numbered; the end of an earlier one comes in front of them.
                        out.append((begins - 1, _CLOSING, "".join(held)) if inside else (begins + n, _WHOLE, "".join(held)))
                        n += not inside
                        open_, inside, held = False, False, []
                if open_:
                    held.append(text[start:])
                if len(out) >= 1000:
                    yield _batch(file, begins, out, whole)
                    out = []
                text = following
            if open_:
                out.append((begins + n, _BETWEEN if inside else _OPENING, "".join(held)))
            if out:
                yield _batch(file, begins, out, whole)

    return find


def _batch(file: str, begins: int, out: list, whole: bool) -> pa.RecordBatch:
    rows = [{"file": file, "begins": begins, "place": place, "kind": kind, "text": t, "whole": whole} for place, kind, t in out]
    return pa.RecordBatch.from_pylist(rows, schema=_PIECE)


def json_texts(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """(file, place, text, whole): the text of every record.

    ``place`` grows along a file; ``numbered`` makes it count the file's records from 0, for one more pass over the files.
    """
    lines = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begins"), "value")
    changes = lines.mapInArrow(_changes, _CHANGE)
    # A group call a file: rows are few, but many small files must not end up in one task.
    dealt = changes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    states = staged(dealt.groupBy("file").applyInPandas(_states, _STATE), "splits")
    if states.count() > MAX_SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")
    known = {(r["file"], r["begins"]): (r["level"], r["quoted"], r["depth"], r["listed"], r["whole"], r["final"]) for r in states.collect()}
    shared = spark.sparkContext.broadcast(known)
    pieces = lines.mapInArrow(_pieces(shared), "file STRING, begins LONG, place LONG, kind INT, text STRING, whole BOOLEAN")
    records = pieces.filter(F.col("kind") == _WHOLE)
    # At most two pieces a split are no whole records: they are read again and joined. What numbers the records is kept by the same pass.
    told = pieces if numbered else pieces.filter(F.col("kind") != _WHOLE)
    told = staged(told.withColumn("text", F.when(F.col("kind") != _WHOLE, F.col("text"))), "borders")
    cut = told.filter(F.col("kind") != _WHOLE)
    of_file = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((F.col("kind") == _OPENING).cast("int")).over(of_file)
    joined = cut.withColumn("run", run).groupBy("file", "run").agg(
        F.min_by("begins", "place").alias("begins"), F.min("place").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"),
        F.first("whole").alias("whole"), F.max("kind").alias("ends"),
    )
    every = records.select("file", "begins", "place", "text", "whole").unionByName(
        joined.filter(F.col("ends") == _CLOSING).select("file", "begins", "place", "text", "whole")
    )
    if numbered:
        begun = told.filter(F.col("kind").isin(_WHOLE, _OPENING)).groupBy("file", "begins").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("file").orderBy("begins")) - F.col("n")
        # One row per split, as bounded as the states above.
        offsets = staged(begun.select("file", "begins", before.alias("before")), "offsets")
        every = every.join(F.broadcast(offsets), ["file", "begins"]).withColumn("place", F.col("place") - F.col("begins") + F.col("before"))
    return every.select("file", "place", "text", "whole")


def json_records(spark: SparkSession, path: str | list[str], schema: str, whole_files: bool = False, numbered: bool = False) -> DataFrame:
    """(file, place, the fields of ``schema``) of every record; ``whole_files`` leaves out files that end early."""
    texts = json_texts(spark, path, numbered)
    texts = texts.filter("whole") if whole_files else texts
    parsed = texts.select("file", "place", F.from_json("text", schema).alias("r"))
    return parsed.select("file", "place", "r.*")
