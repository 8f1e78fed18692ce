"""Near-dedup: fast similarity sketches, banding, exact verification, components.

Sketch. A set is thrown into ``COORDS`` bins in rounds: in each of the first ``COORDS`` rounds every element
picks a bin by a fresh hash; in the rounds after, round by round, all elements go to one given bin. A bin keeps
the smallest (round, hash). Rounds stop once every bin is filled, so small sets fill all coordinates as well,
and the share of equal coordinates of two sets is concentrated around their similarity.

Banding. ``BANDS`` bands of ``ROWS`` coordinates. Two sets of similarity 0.75 share no band with a probability
of (1 - 0.75^4)^48 = 1.2e-8. Documents with equal sets are one node.

Verification never lists all pairs of a bucket, and no pair of a bucket is left out:
1. every member of a bucket is compared with the bucket's centre (the node with most neighbours); links give
   components. The members of buckets that now lie in one component are settled.
2. buckets with several components and at most ``SMALL`` members: each pair from different components is compared.
3. larger ones: such buckets around the same component form a unit. Its nodes are dealt to chunks; a task gets
   two chunks, multiplies their incidence matrices, and returns at most one link per node. Chunk pairs inside
   the component that is already linked are not needed.
All comparisons use full sets. Components of all links give the result.

Cases: null text and text without words have an empty set, linked with nothing; fewer words than a shingle are
one shingle; repeated rows have equal sets and share a component; a null id counts as absent in the smallest id
(a component of null ids only has a null id); an empty table gives an empty result; other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm import blocks as bl
from paperlode.llm.components import components
from paperlode.llm.hashing import U, Windows, mix
from paperlode.llm.tables import Columns, fixed, small as small_table
from paperlode.llm.window_dedup import Words

BANDS, ROWS = 48, 4
COORDS = BANDS * ROWS
SMALL = 8
CHUNK = 256
#: Bytes of text that a task hashes at once.
_PART = 1 << 20

_LOW48 = U((1 << 48) - 1)
_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_EMPTY = U(2**64 - 1)
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U) * U(0xD1B54A32D192ED03))


def sketch(elements: np.ndarray) -> np.ndarray:
    """``COORDS`` coordinates of a non-empty set of 64-bit numbers."""
    bins = np.full(COORDS, _EMPTY, dtype=U)
    at_once = max(1, 2 * COORDS // len(elements))
    for first in range(0, COORDS, at_once):
        rounds = np.arange(first, min(first + at_once, COORDS))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        value = (rounds.astype(U) << U(48))[:, None] | (h & _LOW48)
        np.minimum.at(bins, (((h >> U(48)) * U(COORDS)) >> U(16)).astype(np.int64).ravel(), value.ravel())
        if bins.max() != _EMPTY:
            return bins
    for k in np.flatnonzero(bins == _EMPTY):
        bins[k] = (U(COORDS + k) << U(48)) | (mix(elements ^ _SEEDS[COORDS + k]) & _LOW48).min()
    return bins


def bands_of(coords: np.ndarray) -> np.ndarray:
    rows = coords.reshape(BANDS, ROWS)
    key = _BAND_SEEDS.copy()
    for r in range(ROWS):
        key = mix(key ^ rows[:, r])
    return key


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lowered = [t.lower() for t in texts]
    block = bl.Block([], np.array([len(t) for t in lowered], dtype=np.int64), b"".join(lowered))
    words = Words(block)
    windows = Windows(words.hashes)
    runs = windows.all(size)
    out, first = [], 0
    for n in words.counts:
        if n >= size:
            out.append(np.unique(runs[first:first + n - size + 1]))
        elif n:
            out.append(mix(windows.at(np.array([first]), int(n)) + U(n)))
        else:
            out.append(np.zeros(0, dtype=U))
        first += n
    return out


def node_of(elements: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mix(elements).sum(dtype=U) ^ mix(np.array([len(elements)], dtype=U))[0]
    return int(mix(np.array([total], dtype=U)).astype(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _parts(ids, texts):
    """Lists of at most ``_PART`` bytes of text."""
    some: tuple[list, list] = ([], [])
    size = 0
    for i, t in zip(ids, texts, strict=True):
        t = (t or "").encode("utf-8", "replace")
        some[0].append(i)
        some[1].append(t)
        size += len(t)
        if size >= _PART:
            yield some
            some, size = ([], []), 0
    if some[0]:
        yield some


_SKETCHED = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())),
])


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands) per row (doc_id, text, text_hash); node and bands are null for empty sets."""

    def run(batches):
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for ids, texts in _parts(keys, batch.column(1).to_pylist()):
                out = []
                for (i, h), s in zip(ids, shingle_sets(texts, size), strict=True):
                    row = {"doc_id": i, "text_hash": h, "n_shingles": len(s), "node": None, "bands": None}
                    if len(s):
                        row |= {"node": node_of(s), "bands": bands_of(sketch(s)).astype(np.int64).tolist()}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=_SKETCHED)

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, bands array<bigint>")


_PAYLOAD = pa.schema([("node", pa.int64()), ("payload", pa.binary())])


def _payloads(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, payload): the compressed text of one document for each wanted (node, rep, rep_hash)."""

    def run(batches):
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group, part in _parts(nodes, texts):
                out = [
                    {"node": n, "payload": zstandard.ZstdCompressor(level=3).compress(t)}
                    for n, t, s in zip(group, part, shingle_sets(part, size), strict=True)
                    if len(s) and node_of(s) == n  # another text can have the same hash
                ]
                yield pa.RecordBatch.from_pylist(out, schema=_PAYLOAD)

    on = (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    joined = docs.join(wanted, on).select("node", "text")
    return joined.mapInArrow(run, "node bigint, payload binary").dropDuplicates(["node"])


def _set_of(payload: bytes, size: int) -> np.ndarray:
    return shingle_sets([zstandard.ZstdDecompressor().decompress(payload)], size)[0]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, payloads: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``a`` may be a hot node."""

    def run(batches):
        last, set_a = None, None
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(2)]
            out = []
            for k, (a, b) in enumerate(zip(*names, strict=True)):
                if a != last:
                    last, set_a = a, _set_of(batch.column(2)[k].as_py(), size)
                if similar(set_a, _set_of(batch.column(3)[k].as_py(), size), percent):
                    out.append({"a": a, "b": b})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_LINK)

    # A hot node's text is repeated once per share of its partners. Hot nodes are at most pairs / CHUNK.
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("shares")).filter("shares > 1")
    hot = small_table(many, 100_000)
    left = payloads.select(F.col("node").alias("a"), F.col("payload").alias("payload_a")).join(hot, "a", "left")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    right = payloads.select(F.col("node").alias("b"), F.col("payload").alias("payload_b"))
    dealt = pairs.select("a", "b").join(hot, "a", "left")
    dealt = dealt.withColumn("share", F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    full = dealt.join(right, "b").join(left, ["a", "share"]).select("a", "b", "payload_a", "payload_b")
    return full.mapInArrow(run, "a bigint, b bigint")


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    every = np.concatenate(left + right)
    names, index = np.unique(every, return_inverse=True)
    used = np.bincount(index) > 1
    place = np.cumsum(used) - 1
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    keep = used[index]
    column, owner = place[index[keep]], owner[keep]
    step = 16384
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, int(used.sum()), step):
        lo, hi = np.searchsorted(column, [first, first + step])
        matrix = np.zeros((len(left) + len(right), step), dtype=np.float32)
        matrix[owner[lo:hi], column[lo:hi] - first] = 1
        total += matrix[:len(left)] @ matrix[len(left):].T
    return total


def _chunk_links(size: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "side"])
        sets = [_set_of(p, size) for p in rows["payload"]]
        side, nodes, labels = rows["side"].to_numpy(), rows["node"].tolist(), rows["label"].tolist()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        both = _counts([sets[k] for k in left], [sets[k] for k in right])
        n = np.array([len(s) for s in sets], dtype=np.float32)
        union = n[left][:, None] + n[right][None, :] - both
        near = 100 * both >= percent * union
        root = {x: x for x in labels}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = left[i], right[j]
            x, y = find(labels[a]), find(labels[b])
            if x != y:
                root[x] = y
                out.append((nodes[a], nodes[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _unit_links(units: DataFrame, payloads: DataFrame, size: int, percent: int, chunk: int) -> DataFrame:
    """Links inside units (unit, node, label) between different labels, by pairs of chunks."""
    named = units.withColumn("stray", (F.col("label") != F.col("unit")).cast("int"))
    sizes = named.groupBy("unit").agg(F.sum("stray").alias("s"), F.sum(1 - F.col("stray")).alias("m"))
    sized = named.join(sizes, "unit").join(payloads, "node")
    n_stray, n_main = F.ceil(F.col("s") / chunk).cast("int"), F.ceil(F.col("m") / chunk).cast("int")
    mine = F.when(F.col("stray") == 1, F.pmod(F.xxhash64("node"), F.greatest(n_stray, F.lit(1)))).otherwise(
        n_stray + F.pmod(F.xxhash64("node"), F.greatest(n_main, F.lit(1)))
    ).cast("int")
    # Chunks 0 .. n_stray - 1 hold strays, the others the linked component; one of a pair is of strays.
    partners = F.when(F.col("stray") == 1, F.sequence(F.lit(0), n_stray + n_main - 1)).otherwise(F.sequence(F.lit(0), n_stray - 1))
    dealt = sized.withColumn("mine", mine).withColumn("other", F.explode(partners)).select(
        "unit", "node", "label", "payload",
        F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    return dealt.groupBy("unit", "c1", "c2").applyInPandas(_chunk_links(size, percent), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, small: int = SMALL, chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, label), one row per input row; component_id is the smallest id reachable.

    ``label`` names the component, also where all its ids are null; it is null for empty sets.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plain = plain.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    every = fixed(sketched(plain, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash"))
    nodes = every.filter("node IS NOT NULL").groupBy("node").agg(first.alias("r"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = fixed(nodes.select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "n", "bands"))

    # Memberships of buckets with two nodes or more.
    rows = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    member = fixed(rows.join(shared, "band"))

    # 1. Stars around the centre of each bucket.
    degree = member.groupBy("node").agg(F.sum("members").alias("degree"))
    centre = member.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node", "n")).alias("c"))
    stars = member.join(centre, "band").filter("node <> c.node").filter(
        (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
    ).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = fixed(stars)
    wanted = member.select("node").distinct().join(nodes.select("node", "rep", "rep_hash"), "node")
    payloads = fixed(_payloads(plain, wanted, size))
    links = fixed(verified(stars, payloads, size, percent))

    # 2 and 3. What lies in one bucket and not in one component.
    labels = components(links)
    labelled = member.select("band", "node", "n", "members").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = fixed(labelled)
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band")
    open_ = fixed(labelled.join(mixed, "band"))
    hubs = open_.filter(F.col("members") > small).groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    hubs = hubs.groupBy("band").agg(F.max_by("label", F.struct("k", "label")).alias("unit"))
    units = fixed(open_.join(hubs, "band").select("unit", "node", "label").distinct())
    large = _unit_links(units, payloads, size, percent, chunk)

    # A small bucket inside one unit is settled there.
    home = units.groupBy("node").agg(F.min("unit").alias("unit"))
    few = open_.filter(F.col("members") <= small).join(home, "node", "left")
    left = few.select("band", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.col("unit").alias("unit_a"))
    right = few.select("band", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("unit").alias("unit_b"))
    pairs = left.join(right, "band").filter(
        "a < b AND label_a <> label_b AND NOT coalesce(unit_a = unit_b, false)"
    ).filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()
    rest = verified(pairs.join(stars, ["a", "b"], "left_anti").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), payloads, size, percent)

    final = components(links.unionByName(large).unionByName(rest))
    component = nodes.select("node", "rep").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = component.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = component.join(smallest, "label").select("node", "component_id", "label")
    joined = every.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, "node", "left")
    of_row = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", of_row.alias("component_id"), "label")


def apply(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, exactly one row of each component of :func:`near_duplicates`.

    The row with the smallest id stays (null last), for equal ids the one with the smallest text hash, and one of rows
    that agree in both. Rows with empty sets are in no component and all stay.
    """
    rows = result.filter("label IS NOT NULL").groupBy("doc_id", "text_hash", "label").agg(F.count(F.lit(1)).alias("copies"))
    rows = fixed(rows)
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")
    first = rows.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("i"), F.col("k.text_hash").alias("h"), F.lit(True).alias("stays"))
    met = rows.join(first, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left")
    # Only rows that go, and rows of which one copy stays, are looked up; the other documents pass.
    told = met.filter("stays IS NULL OR copies > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.coalesce("stays", F.lit(False)).alias("__stays")
    )
    mine = Columns(docs)
    on = mine[id_col].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(mine[text_col].cast("string")) == F.col("__hash"))
    marked = mine.df.join(small_table(told, 500_000), on, "left")
    # One of the rows that agree: Spark keeps one per key in front of the shuffle, so copies don't meet in one task.
    others = F.xxhash64(*mine.df.columns)
    copies = marked.filter("__stays").withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(others)))
    return mine.back(marked.filter("__hash IS NULL")).unionByName(mine.back(copies.filter("__nth = 1")))


def digests(result: DataFrame) -> DataFrame:
    """Result of :func:`near_duplicates` with the verdict: the smallest id of each component stays."""
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
