"""Texts packed into blocks, and the search for keys that occur in more than one block.

Substring operators look at every position of every text. Here a task hashes the positions of one block
(some MB of text) at once and sends, for each hash bucket, one row with the block's distinct keys. A key
therefore reaches its bucket once per block, however often it occurs in it, so that a hot passage or a
large group of copies does not pile up in one task. A bucket answers every block with one bit per key.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.tables import fixed

BLOCK = "block bigint, ids array<bigint>, lengths array<bigint>, n_bytes bigint, payload binary"
KEYS = "block bigint, bucket bigint, width int, keys binary"
_ARROW_BLOCK = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("payload", pa.binary()),
])
_ARROW_KEYS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("width", pa.int32()), ("keys", pa.binary())])


class Block:
    """Documents of one block: ids, lengths in bytes, and all bytes in one array without separators."""

    def __init__(self, ids: list, lengths: np.ndarray, data: bytes):
        self.ids, self.lengths, self.raw = ids, lengths, data
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    @classmethod
    def of(cls, row: dict) -> "Block":
        data = zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=max(1, row["n_bytes"]))
        return cls(row["ids"], np.array(row["lengths"], dtype=np.int64), data)

    def text(self, k: int) -> bytes:
        return self.raw[self.starts[k]:self.ends[k]]


def packed(block: int, ids: list, texts: list[bytes]) -> dict:
    data = b"".join(texts)
    return {
        "block": block, "ids": ids, "lengths": [len(t) for t in texts], "n_bytes": len(data),
        "payload": zstandard.ZstdCompressor(level=6).compress(data),
    }


def rows_of(batches) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Whole texts in blocks of about ``block_bytes``, written once; a null text is empty, a longer text is a block."""

    def pack(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            for i, t in zip(batch.column(0).to_pylist(), column, strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([packed(part + number, ids, texts)], schema=_ARROW_BLOCK)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist([packed(part + number, ids, texts)], schema=_ARROW_BLOCK)

    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return fixed(plain.mapInArrow(pack, BLOCK))


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def n_buckets(n_keys: int) -> int:
    """Buckets of at most about 4 million keys, and no fewer than 64."""
    return max(64, n_keys // 4_000_000 + 1)


class KeySet:
    """Distinct keys of one block, in the order in which bits of answers refer to them: by bucket, then key."""

    def __init__(self, bucket: np.ndarray, *parts: np.ndarray):
        """``parts``: the key, from its most significant part on."""
        order = np.lexsort((*reversed(parts), bucket))
        columns = [bucket[order], *(p[order] for p in parts)]
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        self.inverse = np.empty(len(order), dtype=np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.bucket = columns[0][new]
        self.parts = [c[new] for c in columns[1:]]
        self.counts = np.bincount(self.inverse, minlength=len(self.bucket))

    def rows(self, block: int, base: int = 0) -> list[dict]:
        width = sum(p.dtype.itemsize for p in self.parts)
        keys = np.empty(len(self.bucket), dtype=[(f"p{k}", p.dtype) for k, p in enumerate(self.parts)])
        for k, p in enumerate(self.parts):
            keys[f"p{k}"] = p
        edges = np.flatnonzero(np.diff(self.bucket)) + 1
        firsts = np.concatenate([[0], edges]) if len(self.bucket) else []
        return [
            {"block": block, "bucket": int(self.bucket[f]) + base, "width": width, "keys": keys[f:e].tobytes()}
            for f, e in zip(firsts, [*edges, len(self.bucket)], strict=True)
        ] if len(self.bucket) else []

    def answers(self, flags: list[dict] | None, field: str, base: int = 0) -> np.ndarray:
        """The bit of each distinct key that an answer of :func:`repeated` gives."""
        out = np.zeros(len(self.bucket), dtype=bool)
        for f in flags or []:
            first, end = np.searchsorted(self.bucket, [f["bucket"] - base, f["bucket"] - base + 1])
            if end > first:
                out[first:end] = np.unpackbits(np.frombuffer(f[field], dtype=np.uint8), count=end - first).astype(bool)
        return out


def key_rows(blocks: DataFrame, make: Callable[[dict], list[dict]]) -> DataFrame:
    """Rows (block, bucket, width, keys) that ``make`` derives from each block row."""

    def run(batches):
        for row in rows_of(batches):
            made = make(row)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=_ARROW_KEYS)

    return blocks.mapInArrow(run, KEYS)


def _sorted_bucket(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a bucket in order: permutation, equal to the one before, equal to a neighbour, lengths of rows."""
    width = int(rows["width"].iloc[0])
    data = b"".join(rows["keys"])
    lengths = rows["keys"].map(len).to_numpy() // width
    if width <= 8:
        parts = [np.frombuffer(data, dtype=f"<u{width}")]
    else:
        both = np.frombuffer(data, dtype="<u8").reshape(-1, width // 8)
        parts = [both[:, k] for k in range(width // 8)]
    order = np.argsort(parts[0], kind="stable") if len(parts) == 1 else np.lexsort(tuple(reversed(parts)))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = np.logical_and.reduce([p[order][1:] == p[order][:-1] for p in parts])
    tied = same.copy()
    tied[:-1] |= same[1:]
    return order, same, tied, lengths


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: a bit per key, whether it occurs again, and whether it occurs here first."""
    rows = rows.sort_values("block", kind="stable")
    order, same, tied, lengths = _sorted_bucket(rows)
    seen = np.zeros(len(order), dtype=bool)
    seen[order] = tied
    first = np.zeros(len(order), dtype=bool)
    first[order] = ~same
    cuts = np.cumsum(lengths)[:-1]
    return pd.DataFrame({
        "block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(),
        "seen": [np.packbits(x).tobytes() for x in np.split(seen, cuts)],
        "first": [np.packbits(x).tobytes() for x in np.split(first, cuts)],
    })


def repeated(keys: DataFrame, by: Callable[[pd.DataFrame], pd.DataFrame] = answer) -> DataFrame:
    """Per block (block, flags): for each of its keys, whether another block has it and whether this is the first block.

    ``by`` answers the rows of a bucket; by default one bucket is sorted at a time. It holds at most as many keys as :func:`n_buckets` plans for.
    """
    answers = keys.groupBy("bucket").applyInPandas(by, "block bigint, bucket bigint, seen binary, first binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "seen", "first")).alias("flags"))
