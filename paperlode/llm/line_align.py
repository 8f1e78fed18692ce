"""Line dedup by alignment: a document loses the blocks that patience diff aligns with any earlier document.

Windows. Lines are normalised and hashed. A window is the least run of lines from a line on, or up to a line, that has
``min_words`` words. Every line of a common block of ``min_words`` words lies in a window that is in the block, and so
in both documents. Documents that share no window have nothing to cut; only documents that share one are aligned.
There is no limit on a window's frequency.

Rounds. The documents with a window are its holders, in order. Each is aligned with the first holder; a window whose
lines are then cut is settled for that document. Where lines are left (they lie in another order or are repeated, and
the alignment took others), the next 2, 4, 8 ... holders follow, until each window is settled or all its earlier
holders were met. So the result is that of all earlier documents, while a group of copies costs one alignment each.
Only texts that share windows which no alignment takes are paired in full.

Equal texts are one class: its first document stands for it, the others lose all lines (if they have ``min_words``).

Alignment. Patience diff of the two lists of line hashes: equal ends are matched, then lines that occur once in both are
put in order by a longest increasing run, then the gaps between them are treated alike. Runs of matched lines that
follow each other in both documents are blocks. A block of ``min_words`` words or more is deleted from the later document.

Partners (``n_partners``) are the documents it was aligned with and the first holders of its lines.

Order. A document is earlier if its id is smaller (null first), for equal ids if the hash of its text is smaller. Hot
holders are dealt to several tasks, a bounded number of partners each.

Cases: null text has no lines; blank lines have no words but may be part of a block; rows with equal id and text
are one document, and each row gets the same result; an empty table gives an empty result; other columns are ignored.
"""

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.line_quality import normal_line
from paperlode.llm.tables import Columns, fixed, fixed_unsized, small, word_list

MIN_WORDS = 20
#: Partners of a holder that one task gets together.
_TOGETHER = 256
#: An odd number and its inverse modulo 2 ** 64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _ordered(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of line numbers that patience diff matches, in order."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        single = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where]
        for i, j in _ordered(single):
            todo.append((a0, i, b0, j))
            out.append((i, j))
            a0, b0 = i + 1, j + 1
        if single:
            todo.append((a0, a1, b0, b1))
    return sorted(out)


def doomed(later: list[int], words: list[int], earlier: list[int], min_words: int) -> list[int]:
    """Lines of the later document in aligned common blocks of enough words."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*matches(later, earlier), (-1, -1)]:
        if last != (i - 1, j - 1):
            if sum(words[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def windows(hashes: list[int], words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, firsts, ends) of the windows, in time linear in the lines. A clash of keys only costs an alignment."""
    n, least = len(hashes), max(min_words, 1)
    have = np.concatenate([[0], np.cumsum(np.array(words, dtype=np.int64))])
    at = np.arange(n + 1)
    end = np.searchsorted(have, have + least, "left")
    first = np.searchsorted(have, have - least, "right") - 1
    spans = np.concatenate([np.stack([at, end], 1)[end <= n], np.stack([first, at], 1)[first >= 0]])
    spans = np.unique(spans, axis=0)
    # Differences of sums of hash * factor ** place, moved to place 0 by the factor's inverse.
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _FACTOR, dtype=np.uint64))])
    back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(hashes, dtype=np.int64).view(np.uint64) * power[:n])])
    return ((sums[spans[:, 1]] - sums[spans[:, 0]]) * back[spans[:, 0]]).view(np.int64), spans[:, 0], spans[:, 1]


_CUTS = pa.schema([("me", pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64())])), ("cut", pa.list_(pa.int32()))])
_ROWS = pa.schema([("me", _CUTS.field("me").type), ("keys", pa.list_(pa.int64()))])
_ME = "me struct<doc_id:bigint,text_hash:bigint>"


def _window_keys(docs: DataFrame, min_words: int) -> DataFrame:
    """(me, keys): the windows of documents (me, hashes, words, cut) that have a line that is not cut, once per document."""

    def run(batches):
        for batch in batches:
            out = []
            for me, hashes, words, cut in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                # Lines left in front of each line.
                left = np.concatenate([[0], np.cumsum(np.isin(np.arange(len(hashes)), cut or [], invert=True))])
                keys, firsts, ends = windows(hashes, words, min_words)
                out.append({"me": me, "keys": np.unique(keys[left[ends] > left[firsts]])})
            yield pa.RecordBatch.from_pylist(out, schema=_ROWS)

    return docs.select("me", "hashes", "words", "cut").mapInArrow(run, f"{_ME}, keys array<bigint>")


def _window_rows(keyed: DataFrame) -> DataFrame:
    """(h, me): one row per window."""
    return keyed.select(F.explode("keys").alias("h"), "me")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, hashes, words, class), one row per input row, written once; equal lines have equal classes."""
    text = F.col(text_col).cast("string")
    split = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), split.alias("lines"))
    hashed = rows.select(
        "doc_id", "text_hash", F.transform("lines", lambda x: F.xxhash64(normal_line(x))).alias("hashes"),
        F.transform("lines", lambda x: F.size(word_list(x))).alias("words"),
    )
    return fixed(hashed.withColumn("class", F.xxhash64("hashes")))


def first_documents(lines: DataFrame) -> DataFrame:
    """(class, me, hashes, words): the earliest document of each class."""
    return fixed(lines.groupBy("class").agg(F.min(F.struct(F.struct("doc_id", "text_hash").alias("me"), "hashes", "words")).alias("d")).select("class", "d.*"))


def line_partners(single: DataFrame) -> DataFrame:
    """(me, holder): the first holders of a document's lines; the document itself where it is the first."""
    worded = F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] > 0)
    rows = single.select("me", F.explode(F.array_distinct(F.transform(worded, lambda x: x["hashes"]))).alias("h"))
    holders = rows.groupBy("h").agg(F.min("me").alias("holder"), F.count(F.lit(1)).alias("docs"))
    # Written, so that the join has shuffles of its own, whose hot lines Spark can split.
    shared = fixed(holders.filter("docs > 1").drop("docs"))
    own = holders.filter("docs = 1").select(F.col("holder").alias("me"), "holder").distinct()
    return rows.join(shared, "h").select("me", "holder").distinct().unionByName(own).distinct()


def _same(a: str, b: str) -> Column:
    """Equality of two documents, either of which may have a null id."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def aligned_pairs(pairs: DataFrame, single: DataFrame, min_words: int) -> DataFrame:
    """(me, cut) for each pair (me, holder) of documents; a hot holder is dealt to several tasks."""

    def run(batches):
        for batch in batches:
            out = []
            for me, later, words, earlier in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                out.append({"me": me, "cut": doomed(later, words, earlier, min_words)})
            yield pa.RecordBatch.from_pylist(out, schema=_CUTS)

    mine = pairs.join(single.select(F.col("me").alias("of"), F.col("hashes").alias("later"), "words"), _same("me", "of")).drop("of")
    # A hot holder is repeated once per share of its partners, and each partner goes to one share.
    shares = pairs.groupBy("holder").agg(F.ceil(F.count(F.lit(1)) / _TOGETHER).cast("int").alias("shares"))
    shares = fixed(shares.select(F.col("holder").alias("of"), "shares"))
    held = shares.join(single.select("me", F.col("hashes").alias("earlier")), _same("me", "of")).select(
        F.col("of").alias("by"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "earlier"
    )
    dealt = mine.join(shares, _same("holder", "of")).withColumn("mine", F.pmod(F.xxhash64("me"), F.col("shares")).cast("int")).drop("of")
    both = dealt.join(held, _same("holder", "by") & (F.col("mine") == F.col("share")))
    return both.select("me", "later", "words", "earlier").mapInArrow(run, f"{_ME}, cut array<int>")


def cuts_of(single: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(me, cut) and the aligned pairs (me, holder): each of the documents against all earlier ones, in rounds."""
    # The table of documents is small next to the work on it, so that it comes in few partitions.
    tasks = int(single.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = _window_rows(fixed(_window_keys(single.withColumn("cut", F.array().cast("array<int>")).repartition(tasks), min_words)))
    often = small(every.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1").select("h"), 500_000)
    rows = fixed_unsized(every.join(often, "h").withColumn("open", F.lit(True)))
    cuts, met = [], []
    take = 1
    while not rows.isEmpty():
        # The first holders of each window that are not met yet.
        if take == 1:
            heads = rows.groupBy("h").agg(F.min("me").alias("holder"))
        else:
            nth = F.row_number().over(Window.partitionBy("h").orderBy("me"))
            heads = rows.select("h", F.col("me").alias("holder"), nth.alias("nth")).filter(F.col("nth") <= take).drop("nth")
        heads = fixed(heads)
        pairs = fixed(rows.filter("open").join(heads, "h").filter("holder < me").select("me", "holder").distinct())
        met.append(pairs)
        found = aligned_pairs(pairs, single, min_words)
        for earlier in cuts[-1:]:
            found = found.unionByName(earlier)
        cuts.append(fixed(found.groupBy("me").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))))
        # What is left of the windows whose documents were aligned now, behind those holders.
        touched = pairs.select(F.col("me").alias("of")).distinct()
        again = touched.join(cuts[-1].withColumnRenamed("me", "by"), _same("of", "by")).join(single, _same("me", "of"))
        still = _window_rows(_window_keys(again, min_words)).withColumnsRenamed({"h": "k", "me": "of"})
        bound = heads.groupBy("h").agg(F.max("holder").alias("bound"))
        behind = rows.join(bound, "h").filter("me > bound").drop("bound")
        marked = behind.join(still, (F.col("h") == F.col("k")) & _same("me", "of"), "left")
        rest = fixed(marked.select("h", "me", F.col("k").isNotNull().alias("open")))
        last = fixed(rest.filter("open").groupBy("h").agg(F.max("me").alias("last")))
        rows = fixed_unsized(rest.join(last, "h").filter("me <= last").drop("last"))
        take *= 2
    if not cuts:
        none = single.filter("false")
        return none.select("me", F.array().cast("array<int>").alias("cut")), none.select("me", F.col("me").alias("holder"))
    partners = met[0]
    for more in met[1:]:
        partners = partners.unionByName(more)
    return cuts[-1], partners


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_partners, cut), one row per input row; ``cut`` holds the deleted line numbers."""
    lines = lines_of(docs, id_col, text_col)
    single = first_documents(lines)
    cuts, pairs = cuts_of(single, min_words)
    both = line_partners(single).unionByName(pairs).distinct()
    counted = both.groupBy("me").agg(
        F.count(F.when(~F.col("me").eqNullSafe(F.col("holder")), 1)).alias("others"), F.count(F.when(F.col("me").eqNullSafe(F.col("holder")), 1)).alias("own")
    )
    of_class = single.select("class", F.col("me").alias("of")).join(counted, _same("me", "of"), "left").drop("me")
    of_class = of_class.join(cuts.withColumnRenamed("cut", "found"), _same("me", "of"), "left").select("class", F.col("of").alias("me"), "others", "own", "found")
    # A copy has the partners of its class and the first document of it; all its lines are one block.
    is_first = F.col("doc_id").eqNullSafe(F.col("me.doc_id")) & (F.col("text_hash") == F.col("me.text_hash"))
    whole = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x) >= min_words
    others, own = F.coalesce("others", F.lit(0)), F.coalesce("own", F.lit(0))
    partners = F.when(is_first, others).otherwise(others + F.when(whole, 1).otherwise(own))
    none = F.array().cast("array<int>")
    cut = F.when(is_first, F.coalesce("found", none)).otherwise(F.when(whole, F.transform("hashes", lambda x, i: i)).otherwise(none))
    return lines.join(of_class, "class").select(
        "doc_id", "text_hash", F.size("hashes").cast("bigint").alias("n_lines"), partners.cast("bigint").alias("n_partners"), cut.alias("cut"),
    )


def apply(docs: DataFrame, aligned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, without the deleted lines; a text that loses all lines is empty."""
    cuts = aligned.filter(F.size("cut") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("cut").alias("__cut"))
    cuts = cuts.dropDuplicates(["__id", "__hash"])
    mine = Columns(docs)
    text = mine[text_col].cast("string")
    on = mine[id_col].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))

    def without(lines: Column) -> Column:
        # Difference of line numbers by hashing: linear, in order, and equal lines stay apart.
        stay = F.array_except(F.transform(lines, lambda x, i: i), F.col("__cut"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    rest = F.get(F.transform(F.array(F.split(text, "\n")), without), F.lit(0))
    return mine.back(mine.df.join(cuts, on, "left").withColumn(mine.key(text_col), F.when(F.col("__cut").isNotNull(), rest).otherwise(text)))


def digests(docs: DataFrame, aligned: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_partners, n_removed, kept_sha256) per document, the hash of the text that is left."""
    left = apply(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), aligned)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    kept = left.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__hash"), digest.alias("kept_sha256")).dropDuplicates(["__id", "__hash"])
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    return aligned.join(kept, on).select("doc_id", "n_lines", "n_partners", F.size("cut").cast("bigint").alias("n_removed"), "kept_sha256")
