"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are reduced to lower-case words joined by single blanks, so that a window of words is
one byte string with a blank at both ends. All windows of one length in words are searched together: with m the
length of the shortest pattern, a table holds for each block of bytes how far the search may move when that block
ends the current m bytes (blocks in no pattern: m - block + 1). Where it may not move, the patterns whose first m
bytes end in this block are compared directly.

The patterns go to every task. Their size is bounded: items are searched in groups of at most ``group_bytes`` of
text. A larger benchmark means more passes over the documents, whose hits are merged; nothing is left out.

Cases: null text has no words; null items and items without words match nothing; items with equal ids are one
item; an item without id is named by an empty string; null document ids are carried through; repeated rows get
equal results; an empty table gives an empty result; other columns of both inputs are ignored.
"""

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.tables import Columns, small

# Fixed value: word characters are digits, letters a-z and everything beyond ASCII; A-Z count as a-z.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
GROUP_BYTES = 1 << 20
#: Bits of the shift table's index.
_BITS = 20
SCHEMA = "doc_id bigint, mark bigint, text_hash string, n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("text_hash", pa.string()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def patterns_of(items: list[tuple[str, str | None]], window: int) -> dict[int, dict[bytes, set[str]]]:
    """Windows of all items by length in words: bytes of the window -> ids of the items with it."""
    out: dict[int, dict[bytes, set[str]]] = {}
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            key = b" " + b" ".join(words[k:k + size]) + b" "
            out.setdefault(size, {}).setdefault(key, set()).add(name)
    return out


class Search:
    """Wu-Manber search for patterns of one length in words."""

    def __init__(self, patterns: dict[bytes, set[str]]):
        self.least = min(map(len, patterns))
        self.size = max(1, min(12, self.least // 2))
        self.far = min(255, self.least - self.size + 1)
        self.mask = (1 << _BITS) - 1
        self.shift = bytearray([self.far]) * (1 << _BITS)
        self.tails: dict[bytes, list[tuple[bytes, set[str]]]] = {}
        for p, names in patterns.items():
            for end in range(self.size, self.least + 1):
                at = hash(p[end - self.size:end]) & self.mask
                self.shift[at] = min(self.shift[at], self.least - end)
            self.tails.setdefault(p[self.least - self.size:self.least], []).append((p, names))

    def find(self, text: bytes):
        """(first byte, ids) of every occurrence, from left to right."""
        end, n, size, least = self.least, len(text), self.size, self.least
        shift, mask, tails = self.shift, self.mask, self.tails
        while end <= n:
            block = text[end - size:end]
            step = shift[hash(block) & mask]
            if step:
                end += step
                continue
            for p, names in tails.get(block, ()):
                if text.startswith(p, end - least):
                    yield end - least, names
            end += 1


def hits_of(words: list[bytes], searches: dict[int, Search]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal runs of hit words, and the ids of the items that occur."""
    text = b" " + b" ".join(words) + b" "
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for size, search in searches.items():
        seen, at = 0, 0
        for first, names in search.find(text):
            at += text.count(b" ", seen, first)
            seen = first
            found.append((at, at + size))
            items |= names
    return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[bytes, dict[int, Search]] = {}


def _searches(items: list[tuple[str, str | None]], window: int) -> dict[int, Search]:
    """Built once per worker process and group of items."""
    key = xxhash.xxh3_128_digest(repr((items, window)).encode("utf-8", "replace"))
    if key not in _built:
        _built.clear()
        _built[key] = {n: Search(p) for n, p in patterns_of(items, window).items()}
    return _built[key]


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    def run(batches):
        searches = _searches(items, window)
        for batch in batches:
            out = []
            for i, t, m in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                words = words_of(t)
                spans, names = hits_of(words, searches)
                out.append({
                    "doc_id": i, "mark": m, "text_hash": xxhash.xxh3_128_hexdigest((t or "").encode("utf-8", "replace")), "n_words": len(words),
                    "spans": [{"first": a, "end": b} for a, b in spans], "items": sorted(names),
                })
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return docs.mapInArrow(run, SCHEMA)


def item_groups(items: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """Items with a group number; a group holds about ``group_bytes`` of text at most, or one longer item."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total * 2 // group_bytes + 1
    return items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def find_items(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, group_bytes: int = GROUP_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Occurrences per document: (doc_id, mark, text_hash, n_words, spans, items), one row per input row.

    ``mark`` is Spark's hash of the text, by which rows find their document again (null and empty texts differ);
    ``spans`` are maximal runs of hit words [first, end), ``items`` the sorted ids of the items found.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.withColumn("mark", F.xxhash64("text"))
    asked = benchmark.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).cast("string").alias("text")
    )
    grouped, n = item_groups(asked, group_bytes)
    passes = []
    for g in range(n):
        # At most group_bytes of text (or one item): the bound that lets it go to every task.
        rows = grouped.filter(F.col("group") == g).select("item_id", "text").distinct().collect()
        passes.append(_pass(plain, sorted((r["item_id"], r["text"] or "") for r in rows), window))
    if n == 1:
        return passes[0]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    joined = every.groupBy("doc_id", "mark", "text_hash", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / n).cast("int").alias("copies"),
    )
    return joined.select("doc_id", "mark", "text_hash", "n_words", _merge("spans").alias("spans"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("c")).drop("c")


def _merge(spans: str) -> Column:
    """Sorted spans with overlaps joined."""
    kind = "array<struct<first:bigint,end:bigint>>"
    empty = F.array().cast(kind)

    def add(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer).cast(kind))
        return F.when(s["first"] <= last["end"], joined).otherwise(F.concat(a, F.array(s).cast(kind)))

    return F.aggregate(F.col(spans), empty, add)


def _hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def apply(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, without those that :func:`find_items` shows contaminated, by id and text."""
    gone = result.filter(_contaminated(_hit_words())).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    mine = Columns(docs)
    on = mine[id_col].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(mine[text_col].cast("string")) == F.col("__mark"))
    return mine.back(mine.df.join(small(gone, 500_000), on, "left_anti"))


def digests(result: DataFrame) -> DataFrame:
    """Counts per document from :func:`find_items`; contaminated from 5 % of the words on."""
    counted = result.select("doc_id", "n_words", _hit_words().alias("n_hit"), "items")
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"),
    )
