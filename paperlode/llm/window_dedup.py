"""Substring dedup by words: a merged count-min sketch as prefilter, then exact groups of what it suspects.

Pass 1. Every window of ``window`` words is represented by its anchor: the run of ``anchor`` words inside it
with the smallest hash. Equal windows have equal anchors, so a window occurs at most as often as its anchor.
Each block builds a count-min sketch of its anchors: ``DEPTH`` rows of cells with saturating counts, of which
only the touched cells are kept. The sketches are merged by adding the counts of each cell. The merged sketch is
as wide as the data needs and lies distributed by ranges of cells; nothing of it is broadcast. A block gets back
the merged counts of the cells it touched and estimates each anchor by the smallest count over the rows, which is
never below the true count (up to saturation): no repeated window is lost.

Pass 2. Only windows whose anchor is estimated to repeat are grouped, by a 128-bit hash of their words.
Of documents with equal bytes only the first sends windows in this pass; the others share its fate.

Cases: null text and text without words have no words and lose nothing; documents shorter than a window
lose nothing; overlapping copies inside one document count; null ids are carried through; repeated rows
are copies of each other; an empty table gives an empty result; other columns of the input are ignored.
"""

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm import blocks as bl
from paperlode.llm.hashing import U, Windows, mix, word_hashes, word_spans
from paperlode.llm.tables import fixed

DEPTH = 2
#: Cells per row of the sketch for each anchor; 8 lets 12 % of single anchors pass a row, 1.5 % both rows.
CELLS_PER_ANCHOR = 8
#: Counts stop here.
SATURATED = 255
#: A touched cell of a range as it is sent.
CELL = np.dtype([("cell", "<u4"), ("count", "u1")])
BLOCK_BYTES = 2 << 20

SCHEMA = "doc_id bigint, n_words bigint, spans array<struct<first:bigint,end:bigint>>, kept_sha256 string"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()),
])
_STAGE = f"done array<struct<doc_id:bigint,n_words:bigint,spans:array<struct<first:bigint,end:bigint>>,kept_sha256:string>>, whole array<boolean>, suspect binary, {bl.BLOCK}"


def windows_of(n_words: np.ndarray, length: int) -> np.ndarray:
    """First words of the windows of all documents, words being numbered through the block."""
    ends = np.cumsum(n_words)
    starts = ends - n_words
    fits = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int32)
    has = n_words >= length
    np.add.at(fits, starts[has], 1)
    np.add.at(fits, ends[has] - length + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:-1]))


class Words:
    """Word hashes of a block, numbered through; ``counts`` per document."""

    def __init__(self, block: bl.Block):
        # A blank after every document keeps words of neighbours apart.
        data = np.full(len(block.data) + len(block.lengths), 32, dtype=np.uint8)
        shift = np.repeat(np.arange(len(block.lengths)), block.lengths)
        data[np.arange(len(block.data)) + shift] = block.data
        first, end = word_spans(data)
        self.hashes = word_hashes(data, first, end)
        limits = block.ends + np.arange(len(block.lengths)) + 1
        upto = np.searchsorted(first, limits)
        self.counts = np.diff(upto, prepend=0)


def anchors_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the word at which each window's anchor starts, and hashes of all anchor-length runs."""
    starts = windows_of(words.counts, window)
    low = Windows(words.hashes).all(anchor)
    runs = low
    at = np.arange(len(low))
    wide, width = window - anchor + 1, 1
    while width < wide:
        step = min(width, wide - width)
        less = low[step:] < low[:-step]
        low = np.where(less, low[step:], low[:-step])
        at = np.where(less, at[step:], at[:-step])
        width += step
    return starts, at[starts] if len(starts) else starts, runs


class Sketch:
    """Touched cells of one block's count-min sketch with their counts, cut into ranges of cells."""

    def __init__(self, runs: np.ndarray, positions: np.ndarray, width: int, slices: int):
        keys = runs[positions]
        per_slice = -(-width // slices)
        self.rows = []
        for r in range(DEPTH):
            cell = (mix(keys ^ U(0xA5A5 + 77 * r)) % U(width)).astype(np.int64)
            self.rows.append(bl.KeySet(cell // per_slice, (cell % per_slice).astype(np.uint32)))
        self.slices = slices

    def send(self, block: int) -> list[dict]:
        """Per range of cells one row: the touched cells and the block's counts."""
        out = []
        for r, k in enumerate(self.rows):
            cells = np.empty(len(k.bucket), dtype=CELL)
            cells["cell"], cells["count"] = k.parts[0], np.minimum(k.counts, SATURATED)
            firsts = np.flatnonzero(np.diff(k.bucket, prepend=-1))
            ends = [*firsts[1:], len(k.bucket)] if len(firsts) else []
            out += [
                {"block": block, "bucket": int(k.bucket[f]) + r * self.slices, "width": CELL.itemsize, "keys": cells[f:e].tobytes()}
                for f, e in zip(firsts, ends, strict=True)
            ]
        return out

    def estimates(self, flags: list[dict] | None) -> np.ndarray:
        """For each position of an anchor: the smallest merged count over the rows."""
        out = np.full(len(self.rows[0].inverse), SATURATED, dtype=np.uint8)
        merged = {f["bucket"]: f["seen"] for f in flags or []}
        for r, k in enumerate(self.rows):
            counts = np.concatenate([np.zeros(0, dtype=np.uint8), *[
                np.frombuffer(merged[b + r * self.slices], dtype=np.uint8) for b in np.unique(k.bucket).tolist()
            ]])
            out = np.minimum(out, counts[k.inverse])
        return out


def merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of cells: counts of all blocks added, and for each block the sums of the cells it touched."""
    parts = [np.frombuffer(k, dtype=CELL) for k in rows["keys"]]
    total = np.zeros(max(int(p["cell"].max()) for p in parts) + 1, dtype=np.uint16)
    for p in parts:  # A block names a cell once.
        total[p["cell"]] = np.minimum(total[p["cell"]] + p["count"], SATURATED)
    return pd.DataFrame({
        "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(),
        "seen": [total[p["cell"]].astype(np.uint8).tobytes() for p in parts], "first": b"",
    })


def _doc_keys(block: bl.Block) -> bl.KeySet:
    digests = np.array([xxhash.xxh3_128_intdigest(block.text(k)) for k in range(len(block.ids))], dtype=object)
    high = np.array([d >> 64 for d in digests], dtype=U)
    low = np.array([d & (2**64 - 1) for d in digests], dtype=U)
    return bl.KeySet((high % U(64)).astype(np.int64), high, low)


def _kept(text: bytes, keep: np.ndarray | None) -> str:
    words = text.split()
    return hashlib.sha256(b" ".join(words if keep is None else compress(words, keep))).hexdigest()


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 16, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Word spans that repeat: (doc_id, n_words, spans, kept_sha256), one row per input row.

    A word is in a span if some window of ``window`` words over it also starts anywhere else. ``spans`` are
    maximal runs of word numbers [first, end); ``kept_sha256`` is of the other words joined by a blank.
    """
    anchor = min(anchor, window)
    blocks = bl.text_blocks(docs, id_col, text_col, block_bytes)
    n_bytes = bl.total_bytes(blocks)
    # About one word in six bytes, and two anchors for every window - anchor + 2 words.
    n_anchors = max(1, n_bytes // 6 * 2 // (window - anchor + 2))
    width = n_anchors * CELLS_PER_ANCHOR
    slices = bl.n_buckets(n_anchors)
    first_doc_bucket = DEPTH * slices

    def sketch_of(block: bl.Block):
        words = Words(block)
        starts, at, runs = anchors_of(words, window, anchor)
        positions = np.unique(at)
        return words, starts, at, positions, Sketch(runs, positions, width, slices)

    def first_keys(row: dict) -> list[dict]:
        block = bl.Block.of(row)
        *_, sketch = sketch_of(block)
        return sketch.send(row["block"]) + _doc_keys(block).rows(row["block"], first_doc_bucket)

    def suspect(batches):
        for row in bl.rows_of(batches):
            block, flags = bl.Block.of(row), row["flags"]
            words, starts, at, positions, sketch = sketch_of(block)
            anchor_suspect = sketch.estimates(flags) >= 2
            per_word = np.zeros(int(words.counts.sum()) + 1, dtype=bool)
            if len(starts):
                per_word[starts] = anchor_suspect[np.searchsorted(positions, at)]
            docs_ = _doc_keys(block)
            copied = (docs_.counts > 1) | docs_.answers(flags, "seen", first_doc_bucket)
            here = docs_.answers(flags, "first", first_doc_bucket)
            ends = np.cumsum(words.counts)
            done, live, sent = [], [], set()
            for k, i in enumerate(block.ids):
                n, key = int(words.counts[k]), docs_.inverse[k]
                mask = per_word[ends[k] - n:ends[k]]
                whole = bool(copied[key]) and n >= window
                witness = whole and here[key] and key not in sent
                if whole:
                    sent.add(key)
                if witness or not whole and mask.any():
                    live.append((i, k, whole, mask))
                else:
                    spans = [{"first": 0, "end": n}] if whole else []
                    done.append({"doc_id": i, "n_words": n, "spans": spans, "kept_sha256": _kept(b"" if whole else block.text(k), None)})
            out = bl.packed(row["block"], [x[0] for x in live], [block.text(x[1]) for x in live])
            marks = np.concatenate([np.zeros(0, dtype=bool), *[x[3] for x in live]])
            out |= {"done": done, "whole": [x[2] for x in live], "suspect": np.packbits(marks).tobytes()}
            yield pa.RecordBatch.from_pylist([{n: out[n] for n in stage.names}], schema=stage)

    stage = pa.schema([("done", pa.list_(pa.struct(list(_ARROW)))), ("whole", pa.list_(pa.bool_())), ("suspect", pa.binary()), *bl._ARROW_BLOCK])
    # Ranges of cells are added up; behind them come the buckets of whole documents.
    def merge_or_answer(rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows) if rows["bucket"].iloc[0] < first_doc_bucket else bl.answer(rows)

    flags = bl.repeated(bl.key_rows(blocks, first_keys), merge_or_answer)
    staged = fixed(blocks.join(flags, "block", "left").mapInArrow(suspect, _STAGE))

    # Suspects are at most all windows; a bucket then still holds a bounded number of 16-byte keys.
    buckets = bl.n_buckets(n_bytes // 6)

    def window_keys(row: dict) -> tuple[bl.Block, Words, np.ndarray, bl.KeySet]:
        block = bl.Block.of(row)
        words = Words(block)
        n = int(words.counts.sum())
        starts = np.flatnonzero(np.unpackbits(np.frombuffer(row["suspect"], dtype=np.uint8), count=n))
        high = Windows(words.hashes).at(starts, window)
        low = Windows(mix(words.hashes + U(99)), 1).at(starts, window)
        return block, words, starts, bl.KeySet((mix(high + U(5)) % U(buckets)).astype(np.int64), high, low)

    def second_keys(row: dict) -> list[dict]:
        return window_keys(row)[3].rows(row["block"]) if row["ids"] else []

    def finish(batches):
        for row in bl.rows_of(batches):
            out = list(row["done"])
            if row["ids"]:
                block, words, starts, keys = window_keys(row)
                twice = (keys.counts > 1) | keys.answers(row["flags"], "seen")
                change = np.zeros(int(words.counts.sum()) + window + 1, dtype=np.int32)
                hit = starts[twice[keys.inverse]]
                change[hit] += 1
                change[hit + window] -= 1
                covered = np.cumsum(change) > 0
                ends = np.cumsum(words.counts)
                for k, i in enumerate(block.ids):
                    n = int(words.counts[k])
                    mask = np.ones(n, dtype=bool) if row["whole"][k] else covered[ends[k] - n:ends[k]]
                    out.append({"doc_id": i, "n_words": n, "spans": _runs(mask), "kept_sha256": _kept(block.text(k), ~mask)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    again = bl.repeated(bl.key_rows(staged.drop("done"), second_keys))
    return staged.join(again, "block", "left").mapInArrow(finish, SCHEMA)


def digests(result: DataFrame) -> DataFrame:
    """Counts per document from :func:`dedup`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    return result.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")
