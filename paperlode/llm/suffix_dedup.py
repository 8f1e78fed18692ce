"""Substring dedup by bytes: difference-cover sample first, then suffixes of one bucket sorted at a time.

A difference cover D modulo v has, for any two positions i and j, a distance d < v with both i + d and
j + d in D (modulo v). So if two ``length``-byte strings are equal, the strings of ``length - v + 1`` bytes
at i + d and j + d are equal as well, and both are in the sample.

Pass 1, cover sample. Only positions in D are named, by a fingerprint of the ``length - v + 1`` bytes there.
Names are sorted bucket by bucket; a name that occurs twice has a rank, every other position is unique.
A suffix none of whose next v positions has a rank cannot tie with another one for ``length`` bytes: it is
resolved here and never sorted. This settles almost all suffixes from 9 % of the positions.

Pass 2, blockwise suffix sort. The suffixes that remain are dealt to buckets by a fingerprint of their first
``length`` bytes, and one bucket is sorted at a time (by a second, independent fingerprint). Neighbours that
tie for ``length`` bytes are repeats. Order between strings that differ does not matter here, so buckets are
ordered by fingerprint and not by alphabet; a tie is 64 equal bits of one fingerprint in one bucket of the
other. Of documents with equal bytes only the first takes part in this pass; the others share its fate.

Cases: null and empty texts and texts below ``length`` bytes lose nothing; overlapping repeats inside one
document count; matches never cross documents; null ids are carried through; repeated rows are copies of each
other; an empty table gives an empty result; other columns of the input are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm import blocks as bl
from paperlode.llm.hashing import U, Windows, mix
from paperlode.llm.tables import fixed, release

# A difference cover of 12 residues modulo 133 in which every difference occurs.
MODULUS = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
_IN_COVER = np.zeros(MODULUS, dtype=bool)
_IN_COVER[list(COVER)] = True

BLOCK_BYTES = 2 << 20
SCHEMA = "doc_id bigint, n_bytes bigint, spans array<struct<first:bigint,end:bigint>>, kept_sha256 string"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()),
])
_STAGE = f"done array<struct<doc_id:bigint,n_bytes:bigint,spans:array<struct<first:bigint,end:bigint>>,kept_sha256:string>>, whole array<boolean>, live binary, {bl.BLOCK}"
_ARROW_STAGE = pa.schema([("done", pa.list_(pa.struct(list(_ARROW)))), ("whole", pa.list_(pa.bool_())), ("live", pa.binary()), *bl._ARROW_BLOCK])
#: Bytes that one element of a rolling hash covers.
_GRAM = 8


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as mixed numbers; zeros follow the end."""
    padded = np.zeros(len(data) + _GRAM, dtype=np.uint8)
    padded[:len(data)] = data
    return mix(np.ndarray(len(data), dtype="<u8", buffer=padded.data, strides=(1,)).astype(U))


class Positions:
    """What the two passes need of one block."""

    def __init__(self, block: bl.Block, length: int, buckets: int):
        self.block, self.length = block, length
        self.grams = _grams(block.data)
        self.hashes = Windows(self.grams)
        self.buckets = buckets

    def room(self, at: np.ndarray) -> np.ndarray:
        """Bytes from each position to the end of its document."""
        b = self.block
        return b.ends[np.searchsorted(b.ends, at, side="right")] - at

    def sample(self) -> tuple[np.ndarray, bl.KeySet]:
        """Cover positions with enough text behind them, and their names."""
        n, size = len(self.block.data), self.length - MODULUS + 1
        rows = np.arange(-(-n // MODULUS)) * MODULUS
        at = (rows[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        at = at[self.room(at) >= size] if len(at) else at
        name = self.hashes.at(at, size - _GRAM + 1)
        return at, bl.KeySet(((name >> U(32)) % U(self.buckets)).astype(np.int64), name.astype(np.uint32))

    def live(self, ranked: np.ndarray) -> np.ndarray:
        """Suffixes with a ranked cover position among their next v positions and room for ``length`` bytes."""
        change = np.zeros(len(self.block.data) + 1, dtype=np.int32)
        np.add.at(change, np.maximum(ranked - MODULUS + 1, 0), 1)
        np.add.at(change, ranked + 1, -1)
        out = np.cumsum(change[:-1]) > 0
        at = np.flatnonzero(out)
        if len(at):
            out[at[self.room(at) < self.length]] = False
        return out

    def suffixes(self, starts: np.ndarray) -> bl.KeySet:
        size = self.length - _GRAM + 1
        other = Windows(self.grams, 1).at(starts, size)
        return bl.KeySet((other % U(self.buckets)).astype(np.int64), self.hashes.at(starts, size))


def _doc_keys(block: bl.Block) -> bl.KeySet:
    digests = [xxhash.xxh3_128_intdigest(block.text(k)) for k in range(len(block.ids))]
    high = np.array([d >> 64 for d in digests], dtype=U)
    low = np.array([d & (2**64 - 1) for d in digests], dtype=U)
    return bl.KeySet((high % U(64)).astype(np.int64), high, low)


def _row(i, n: int, gone: np.ndarray | None, text: bytes) -> dict:
    """``gone``: which bytes go; None for no byte."""
    if gone is None:
        return {"doc_id": i, "n_bytes": n, "spans": [], "kept_sha256": hashlib.sha256(text).hexdigest()}
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    spans = [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    return {"doc_id": i, "n_bytes": n, "spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Byte spans that repeat: (doc_id, n_bytes, spans, kept_sha256), one row per input row.

    A byte is in a span if some ``length``-byte string over it also starts anywhere else. ``spans`` are maximal
    runs of byte numbers [first, end); ``kept_sha256`` is of the other bytes. ``length`` is at least 141.
    """
    if length < MODULUS + _GRAM:
        raise ValueError(f"length must be at least {MODULUS + _GRAM}")
    blocks = bl.text_blocks(docs, id_col, text_col, block_bytes)
    n_bytes = bl.total_bytes(blocks)
    names = bl.n_buckets(n_bytes * len(COVER) // MODULUS)
    # Live suffixes are at most all bytes; 4 million keys of a bucket are 32 MB.
    buckets = bl.n_buckets(n_bytes)

    def first_keys(row: dict) -> list[dict]:
        block = bl.Block.of(row)
        _, keys = Positions(block, length, names).sample()
        return keys.rows(row["block"]) + _doc_keys(block).rows(row["block"], names)

    def resolve(batches):
        for row in bl.rows_of(batches):
            block, flags = bl.Block.of(row), row["flags"]
            positions = Positions(block, length, names)
            at, keys = positions.sample()
            rank = (keys.counts > 1) | keys.answers(flags, "seen")
            live = positions.live(at[rank[keys.inverse]])
            docs_ = _doc_keys(block)
            copied = (docs_.counts > 1) | docs_.answers(flags, "seen", names)
            here = docs_.answers(flags, "first", names)
            done, rest, sent = [], [], set()
            for k, i in enumerate(block.ids):
                n, key = int(block.lengths[k]), docs_.inverse[k]
                mask = live[block.starts[k]:block.ends[k]]
                whole = bool(copied[key]) and n >= length
                witness = whole and here[key] and key not in sent
                if whole:
                    sent.add(key)
                if witness or not whole and mask.any():
                    rest.append((i, k, whole, mask))
                else:
                    done.append(_row(i, n, np.ones(n, dtype=bool) if whole else None, block.text(k)))
            out = bl.packed(row["block"], [x[0] for x in rest], [block.text(x[1]) for x in rest])
            marks = np.concatenate([np.zeros(0, dtype=bool), *[x[3] for x in rest]])
            out |= {"done": done, "whole": [x[2] for x in rest], "live": np.packbits(marks).tobytes()}
            yield pa.RecordBatch.from_pylist([{n: out[n] for n in _ARROW_STAGE.names}], schema=_ARROW_STAGE)

    flags = bl.repeated(bl.key_rows(blocks, first_keys))
    staged = fixed(blocks.join(flags, "block", "left").mapInArrow(resolve, _STAGE))
    del blocks, flags
    release(docs.sparkSession)

    def suffixes(row: dict) -> tuple[bl.Block, np.ndarray, bl.KeySet]:
        block = bl.Block.of(row)
        starts = np.flatnonzero(np.unpackbits(np.frombuffer(row["live"], dtype=np.uint8), count=len(block.data)))
        return block, starts, Positions(block, length, buckets).suffixes(starts)

    def second_keys(row: dict) -> list[dict]:
        return suffixes(row)[2].rows(row["block"]) if row["ids"] else []

    def finish(batches):
        for row in bl.rows_of(batches):
            out = list(row["done"])
            if row["ids"]:
                block, starts, keys = suffixes(row)
                twice = (keys.counts > 1) | keys.answers(row["flags"], "seen")
                hit = starts[twice[keys.inverse]]
                change = np.zeros(len(block.data) + length + 1, dtype=np.int32)
                change[hit] += 1
                change[hit + length] -= 1
                covered = np.cumsum(change) > 0
                for k, i in enumerate(block.ids):
                    n = int(block.lengths[k])
                    gone = np.ones(n, dtype=bool) if row["whole"][k] else covered[block.starts[k]:block.ends[k]]
                    out.append(_row(i, n, gone, block.text(k)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    again = bl.repeated(bl.key_rows(staged.drop("done"), second_keys))
    return staged.join(again, "block", "left").mapInArrow(finish, SCHEMA)


def digests(result: DataFrame) -> DataFrame:
    """Counts per document from :func:`dedup`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
