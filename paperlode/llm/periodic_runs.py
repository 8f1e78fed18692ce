"""Periodic runs of words: a suffix automaton whose link tree is accessed once per appended word.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbour extends
and that is at least ``max(min_length, min_exponent * q)`` words long.

Method. Words are appended to a suffix automaton one by one. Its suffix links form a tree, held as a link-cut tree: each
path tree holds states whose strings were last seen at the same place, so its colour is that last end. Appending word i
accesses the path from the new state to the root: every segment on it has one previous end e, and its deepest state
gives the longest string L that ends at e and at i. If i - e <= L, the last 2 * (i - e) words are a square; the square
is extended to both sides as far as the period holds, which gives the run. Afterwards the whole path has colour i.
A clone takes its place above the state it was split from, in the same path tree. Accesses change O(n log n) segments
in all. Periods that are multiples of a smaller one give the same stretch as that one and are dropped.

Which words the automaton reads. Inside a run each k-gram occurs again q words before or after, with
k = min over q of max(min_length, min_exponent * q) - 2 * q + 1 (5 for runs of 6 words and 4 periods). So a run lies in a stretch
of consecutive k-grams that each occur twice in it. Stretches are found by sorting hashes of all k-grams of many texts
at once, again inside the stretches found, as long as that narrows them; equal k-grams have equal hashes, so no run is lost.
The automaton and the extension compare the words themselves.

A text is read by one task and takes a few times its own size there, and some 0.5 KB for each word of its longest stretch;
texts do not meet, so nothing is shuffled.

Cases: a null or empty text and a text without words have no run; null ids are carried through; repeated rows get equal
results; ties for the longest run go to the smallest start, then period; an empty table gives an empty result; other
columns of the input are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.hashing import U, Windows, mix, word_hashes, word_spans
from paperlode.llm.tables import word_list

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Bytes of text that are hashed together.
CHUNK_BYTES = 4 << 20

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])


class LinkTree:
    """The suffix-link tree as path trees (splay trees by depth); the root of a path tree carries the path's last end."""

    def __init__(self):
        # State 0 stands for "none", state 1 is the root of the links.
        self.left, self.right, self.up, self.seen = [0, 0], [0, 0], [0, 0], [0, 0]

    def add(self, parent: int) -> None:
        """A new state below ``parent``, a path of its own that was never seen."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(parent)
        self.seen.append(0)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p] = x
        up[x] = g
        self.seen[x] = self.seen[p]

    def splay(self, x: int) -> None:
        """Make x the root of its path tree."""
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def split_above(self, x: int) -> None:
        """A new state (the last one added) between x and its parent, last seen where x was."""
        made = len(self.up)
        self.splay(x)
        above = self.left[x]
        self.left.append(above)
        self.right.append(0)
        self.up.append(x)
        self.seen.append(0)
        if above:
            self.up[above] = made
        self.left[x] = made

    def access(self, x: int, now: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from x to the root; gives (previous end, deepest state) of each segment that was seen."""
        below, y = 0, x
        while y:
            self.splay(y)
            end = self.seen[y]
            if end:
                yield end, y
            rest = self.right[y]
            if rest:
                self.seen[rest] = end
            self.right[y] = below
            below = y
            y = self.up[y]
        self.seen[below] = now
        self.splay(x)


def runs_of(words: list, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of hashable words, by start and period."""
    n, tree = len(words), LinkTree()
    edges: list[dict] = [{}, {}]
    link, size = [0, 0], [0, 0]
    last = 1
    until: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words, 1):
        state = len(size)
        size.append(i)
        link.append(1)
        edges.append({})
        at = last
        while at and word not in edges[at]:
            edges[at][word] = state
            at = link[at]
        if not at:
            tree.add(1)
        else:
            met = edges[at][word]
            if size[met] == size[at] + 1:
                link[state] = met
                tree.add(met)
            else:
                clone = state + 1
                tree.add(clone)
                size.append(size[at] + 1)
                link.append(link[met])
                edges.append(dict(edges[met]))
                tree.split_above(met)
                while at and edges[at].get(word) == met:
                    edges[at][word] = clone
                    at = link[at]
                link[met] = link[state] = clone
        last = state
        for end, deepest in tree.access(state, i):
            period = i - end
            if period <= size[deepest] and until.get(period, 0) < i:
                first, stop = i - size[deepest] - period, i
                while first and words[first - 1] == words[first - 1 + period]:
                    first -= 1
                while stop < n and words[stop] == words[stop - period]:
                    stop += 1
                until[period] = stop
                if stop - first >= max(min_length, min_exponent * period):
                    found[first, stop] = min(period, found.get((first, stop), period))
    return sorted((first, stop - first, period) for (first, stop), period in found.items())


def gram_of(min_length: int, min_exponent: float) -> int:
    """Length for which every k-gram of every run has an equal one in the run, a period before or after it."""
    return min(max(min_length, math.ceil(min_exponent * q)) - 2 * q + 1 for q in range(1, min_length + 1))


def stretches(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of stretches that can hold runs; ``counts`` are words per text, words are numbered through."""
    text = np.repeat(np.arange(len(counts)), counts)
    grams = Windows(hashes).all(k)
    at = np.flatnonzero(text[:len(grams)] == text[k - 1:]) if len(grams) else np.zeros(0, dtype=np.int64)
    group = text[at]
    while len(at):
        keys = mix(grams[at] + group.astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        before = len(at)
        at, old = at[twice], group[twice]
        group = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (np.diff(old) != 0)])) if len(at) else old
        if len(at) > 0.95 * before:
            break
    if not len(at):
        return at, at
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    return at[edge], at[np.append(edge[1:], len(at)) - 1] + k


def _rows(ids: list, texts: list[bytes], min_length: int, min_exponent: float) -> list[dict]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    first, end = word_spans(data)
    limits = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, limits)
    counts = np.diff(upto, prepend=0)
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(*stretches(word_hashes(data, first, end), counts, gram_of(min_length, min_exponent)), strict=True):
        found.setdefault(int(np.searchsorted(upto, a, side="right")), []).append((int(a), int(b)))
    out = []
    for k, text in enumerate(texts):
        words, base = text.split(), int(upto[k] - counts[k])
        runs = [
            {"start": a - base + start, "length": length, "period": period}
            for a, b in found.get(k, []) for start, length, period in runs_of(words[a - base:b - base], min_length, min_exponent)
        ]
        if runs:
            change = np.zeros(len(words) + 1, dtype=np.int32)
            for r in runs:
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            words = [w for w, deep in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not deep]
        out.append({"doc_id": ids[k], "n_words": int(counts[k]), "runs": runs, "collapsed": b" ".join(words).decode()})
    return out


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT
) -> DataFrame:
    """One row per input row: doc_id, n_words, all runs by start and period, and the text of the words that stay.

    A word goes if some run holds it after that run's first period; the others are joined by one blank.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run repeats: min_exponent and min_length must be at least 2")

    def find(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            ids: list = []
            texts: list[bytes] = []
            size = 0
            for i, t in zip(batch.column(0).to_pylist(), column, strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(_rows(ids, texts, min_length, min_exponent), schema=_ARROW)
                    ids, texts, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_pylist(_rows(ids, texts, min_length, min_exponent), schema=_ARROW)

    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(find, SCHEMA)


def with_planted_tail(doc_id: Column, text: Column) -> Column:
    """The text whose last words repeat, for a tenth of all ids: from word a on, words a .. a + p - 1 return for ever.

    With h the CRC-32 of the decimal id, g = h // 10 and n words: if h % 10 = 0, a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Other texts, and rows without id, are left as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p)))), " ")

    planted = F.get(F.transform(F.array(word_list(text)), lambda w: F.when(F.size(w) > 0, tail(w))), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(planted, text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests per document from :func:`periodic_runs`."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
