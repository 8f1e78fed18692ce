"""Token ids in compressed shard files: a wavelet matrix per shard.

Documents are dealt by ranges of their id and sorted, so shards follow each other in ascending id order. A task
encodes its documents and writes shards of about ``shard_tokens`` ids. A shard is one row of a Parquet file:

  shard       number; shards in this order hold the documents in order
  doc_ids     ids of its documents; doc_tokens: their lengths in ids, each with the end id
  n_tokens    all ids
  zeros       per bit plane, from the highest bit on: how many bits are 0
  planes      the bit planes, each of ceil(n / 8) bytes, compressed with zstd

Plane b holds bit b of all ids in the order that the planes above have sorted them into: zeros first, ones
behind, each in their old order. With counts of ones per 512 bits (made when a shard is opened) a shard answers
access, rank, select and occurrence lookup without being decoded.

Encoding. A text is cut at single blanks between other characters. The tokenizer never joins across such a cut,
so the pieces are encoded apart and their ids are put together. Some megabytes of text are cut at a time and the distinct
pieces of all of them looked up, so a worker's table of encoded pieces is asked once for each. A worker keeps the tokenizer
and this table, of bounded size, from task to task. Everything else in a
text (runs of white space, line breaks) stays inside a piece. The splitter and the model of the tokenizer file do
the work; only pieces of Latin letters, digits, ASCII signs and single line breaks are split here, by the same rule.

Cases: null and empty texts have the end id only; null document ids come first; equal ids are ordered by text;
repeated rows are written as often as they occur; an empty table gives no shard and an empty result; other columns
are ignored. Strings of special tokens in a text are ordinary text.
"""

import re
import sys
import zlib
from codecs import charmap_decode
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 16
END_ID = 0
SHARD_TOKENS = 1 << 20
_BLOCK = 512
#: Entries after which a worker's table of encoded pieces turns: those not asked for until the next turn go. Longer pieces are not kept.
_KEEP = 100_000
_KEEP_LENGTH = 64
#: Bytes of text that are cut at a time.
_ROUND = 8 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Texts with a blank that is no cut: at an end or beside other white space, as Python's \s has it.
_SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace()) + "]"
_ODD = f"^ | $| {_SPACE}|{_SPACE} "
# A comma or full stop behind a letter, at the end of a piece, is a part of its own.
_STOP = "[A-Za-z][.,]$"
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SIGN = r"!-&(-/:-@\[-`{-~"  # without the apostrophe, which may begin a contraction
_WORD = re.compile(f" ?[{_LETTER}]+")
_PLAIN = re.compile(f" ?[{_LETTER}0-9{_SIGN}]+(?:\n[{_LETTER}0-9{_SIGN}]+)*")
_PARTS = re.compile(f" ?[{_LETTER}]+| ?[0-9]+| ?[{_SIGN}]+|\n")
# Byte-level tokenizers write a byte as a printable character: itself, or the next one from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = dict(zip((b for b in range(256) if b not in _PRINTABLE), range(256, 324), strict=True))
_ALPHABET = "".join(chr(_OTHER.get(b, b)) for b in range(256))
_ID_BYTES = [n.to_bytes(2, "little") for n in range(1 << BITS)]

SHARD = "shard bigint, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, zeros array<bigint>, planes binary"
_ARROW_SHARD = pa.schema([
    ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.binary()),
])


class WaveletMatrix:
    """Succinct sequence of ids below 2**16."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        zeros, planes = [], []
        for b in reversed(range(BITS)):
            bit = (ids & np.uint16(1 << b)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            ids = np.concatenate([ids[low], ids[high]])
        return cls(len(ids), zeros, planes)

    @classmethod
    def load(cls, n: int, zeros: list[int], payload: bytes) -> "WaveletMatrix":
        size = -(-n // 8)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, size * BITS)), dtype=np.uint8)
        return cls(n, zeros, [data[k * size:(k + 1) * size] for k in range(BITS)])

    def payload(self) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in self.planes))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids: the sorting steps are undone from the last plane up."""
        now = np.zeros(self.n, dtype=np.uint16)
        for level in reversed(range(BITS)):
            bit = self._bits(level)
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:self.zeros[level]]
            before[np.flatnonzero(bit)] = now[self.zeros[level]:] | np.uint16(1 << (BITS - 1 - level))
            now = before
        return now

    def _rank1(self, level: int, at: int) -> int:
        """Ones in front of a position."""
        if self._ones is None:
            self._ones = []
            for p in self.planes:
                padded = np.zeros(-(-len(p) // (_BLOCK // 8)) * (_BLOCK // 8), dtype=np.uint8)
                padded[:len(p)] = p
                per_block = np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64)
                self._ones.append(np.concatenate([[0], np.cumsum(per_block)]))
        block = at // _BLOCK
        rest = self.planes[level][block * _BLOCK // 8:-(-at // 8)].copy()
        if at % 8:
            rest[-1] &= (1 << (at % 8)) - 1
        return int(self._ones[level][block] + np.bitwise_count(rest).sum())

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for level in range(BITS):
            ones = self._rank1(level, at)
            if self.planes[level][at // 8] >> (at % 8) & 1:
                value |= 1 << (BITS - 1 - level)
                at = self.zeros[level] + ones
            else:
                at -= ones
        return value

    def _range(self, token: int, first: int, end: int) -> tuple[int, int]:
        for level in range(BITS):
            a, b = self._rank1(level, first), self._rank1(level, end)
            if token >> (BITS - 1 - level) & 1:
                first, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, end = first - a, end - b
        return first, end

    def count(self, token: int, first: int = 0, end: int | None = None) -> int:
        """Occurrences of an id between two positions."""
        a, b = self._range(token, first, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0 on; -1 if there are fewer."""
        first, end = self._range(token, 0, self.n)
        if not 0 <= k < end - first:
            return -1
        at = first + k
        for level in reversed(range(BITS)):
            one = token >> (BITS - 1 - level) & 1
            wanted = at - self.zeros[level] if one else at
            low, high = wanted, self.n - 1  # the position with that many equal bits in front
            while low < high:
                mid = (low + high) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if one else mid + 1 - ones) > wanted:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of an id, ascending: its run in the last order, followed back through the planes."""
        first, end = self._range(token, 0, self.n)
        at = np.arange(first, end)
        for level in reversed(range(BITS)):
            bit = self._bits(level)
            if token >> (BITS - 1 - level) & 1:
                at = np.flatnonzero(bit)[at - self.zeros[level]]
            else:
                at = np.flatnonzero(~bit)[at]
        return at


class Known(dict):
    """Ids of pieces and their parts, as little-endian 16-bit numbers. A missing piece is cut by the splitter, its parts go to the model.

    It holds at most ``2 * _KEEP`` entries, however much a worker reads: when it is full it becomes ``old``, from which
    pieces come back as they are asked for, and what ``old`` still holds at the next turn is forgotten.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self._split, self._tokenize = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize

    def _kept(self, text: str, ids: bytes) -> bytes:
        if len(text) <= _KEEP_LENGTH:
            if len(self) >= _KEEP:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of what the splitter leaves whole."""
        ids = self.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                ids = b"".join([_ID_BYTES[t.id] for t in self._tokenize(charmap_decode(part.encode(), "strict", _ALPHABET)[0])])
            self._kept(part, ids)
        return ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is not None:
            return self._kept(piece, ids)
        if _WORD.fullmatch(piece):
            return self._part(piece)
        parts = _PARTS.findall(piece) if _PLAIN.fullmatch(piece) else [piece[first:end] for _, (first, end) in self._split(piece)]
        return self._kept(piece, b"".join(map(self._part, parts)))


class Encoder:
    """The tokenizer with a table of pieces it has encoded; one per worker process and file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Known(self.tokenizer)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        # This package is sent to the workers by value, anew for each task, so that what a class or module of it holds ends with the task.
        made = vars(sys.modules.setdefault("_paperlode_encoders", ModuleType("_paperlode_encoders")))
        if path not in made:
            made[path] = cls(path)
        return made[path]

    @staticmethod
    def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The parts between safe cuts: numbers of the texts in the order they come in, pieces of each, all pieces."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        hard = [_CUT.split(t) for t in texts.filter(odd).to_pylist()]
        odd = odd.to_numpy(zero_copy_only=False)
        sizes = np.concatenate([pc.list_value_length(plain).to_numpy(), np.array([len(h) for h in hard], dtype=np.int64)]).astype(np.int64)
        flat = pa.concat_arrays([plain.flatten(), pa.array([p for h in hard for p in h], pa.large_string())])
        return np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), sizes, flat

    def _lookup(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces."""
        stop = pc.match_substring_regex(pieces, _STOP)
        ends = pc.if_else(stop, pc.utf8_slice_codeunits(pieces, -1), pa.scalar("", pa.large_string())).dictionary_encode()
        stems = pc.if_else(stop, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        of = [pa.array(list(map(self.known.__getitem__, _strings(x.dictionary))), pa.large_binary()).take(x.indices) for x in (stems, ends)]
        return pc.binary_join_element_wise(*of, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        if not len(texts):
            return []
        order, sizes, flat = self.pieces(texts)
        ends = np.cumsum(sizes)
        later = np.ones(len(flat), dtype=bool)
        later[ends - sizes] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        empty, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        # First pieces have no blank in front, the others do.
        values = self._lookup(pa.concat_arrays([flat.take(pa.array(ends - sizes)), pc.binary_join_element_wise(empty, coded.dictionary, blank)]))
        which = np.empty(len(flat), dtype=np.int64)
        which[~later] = np.arange(len(texts))
        which[later] = coded.indices.to_numpy().astype(np.int64) + len(texts)
        _, bounds, data = values.take(pa.array(which)).buffers()
        bounds, data = np.frombuffer(bounds, dtype=np.int64)[np.concatenate([[0], ends])].tolist(), memoryview(data or b"")
        out = [b""] * len(texts)
        for n, first, end in zip(order.tolist(), bounds, bounds[1:]):
            out[n] = bytes(data[first:end])
        return out


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _rounds(ids: pa.Array, texts: pa.Array):
    """Some megabytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ids):
        done = int(ends[first - 1]) if first else 0
        end = min(int(np.searchsorted(ends, done + _ROUND)) + 1, len(ids))
        yield ids.slice(first, end - first).to_pylist(), texts.slice(first, end - first)
        first = end


def shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shard rows (see the module) of all documents."""

    def run(batches):
        encoder = Encoder.of(tokenizer_path)
        end = np.array([END_ID], dtype="<u2").tobytes()
        part, number = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        lengths: list[int] = []
        data: list[bytes] = []

        def shard():
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(data), dtype="<u2"))
            return pa.RecordBatch.from_pylist([{
                "shard": part + number, "doc_ids": ids, "doc_tokens": lengths, "n_tokens": matrix.n, "zeros": matrix.zeros, "planes": matrix.payload(),
            }], schema=_ARROW_SHARD)

        total = 0
        for batch in batches:
            for some, texts in _rounds(batch.column(0), batch.column(1)):
                for i, e in zip(some, encoder.encode(texts), strict=True):
                    ids.append(i)
                    data.append(e + end)
                    lengths.append(len(e) // 2 + 1)
                    total += lengths[-1]
                    if total >= shard_tokens:
                        yield shard()
                        ids, lengths, data, total, number = [], [], [], 0, number + 1
        if ids:
            yield shard()

    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = plain.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions("id", "text")
    return dealt.mapInArrow(run, SHARD)


def write(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Writes the shard files of all documents below ``path``."""
    shards(docs, tokenizer_path, **options).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


_DOC = pa.schema([("shard", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def documents(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; start counts the ids before it."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}
                ids = WaveletMatrix.load(row["n_tokens"], row["zeros"], row["planes"]).decode().astype("<u4").tobytes()
                out, first = [], 0
                for pos, (i, n) in enumerate(zip(row["doc_ids"], row["doc_tokens"], strict=True)):
                    crc = zlib.crc32(ids[4 * first:4 * (first + n)])
                    out.append({"shard": row["shard"], "pos": pos, "doc_id": i, "first": first, "n_tokens": n, "ids_crc32": crc})
                    first += n
                yield pa.RecordBatch.from_pylist(out, schema=_DOC)

    rows = stored.mapInArrow(run, "shard bigint, pos bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    # One row per shard: small beside the shards themselves.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(stored: DataFrame, token: int) -> DataFrame:
    """(doc_id, offset) of every occurrence of an id, from the planes alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}
                at = WaveletMatrix.load(row["n_tokens"], row["zeros"], row["planes"]).occurrences(token)
                ends = np.cumsum(row["doc_tokens"])
                doc = np.searchsorted(ends, at, side="right")
                first = ends - np.array(row["doc_tokens"])
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": row["doc_ids"][d], "offset": int(a - first[d])} for d, a in zip(doc, at, strict=True)], schema=schema
                )

    return stored.mapInArrow(run, "doc_id bigint, offset bigint")


def counts(stored: DataFrame, token: int) -> DataFrame:
    """(shard, n) occurrences of an id per shard, by rank."""
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = {n: batch.column(j)[k].as_py() for j, n in enumerate(batch.schema.names)}
                out.append({"shard": row["shard"], "n": WaveletMatrix.load(row["n_tokens"], row["zeros"], row["planes"]).count(token)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return stored.mapInArrow(run, "shard bigint, n bigint")
