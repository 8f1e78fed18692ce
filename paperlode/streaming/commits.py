"""Commit records: what a batch has written becomes visible all at once.

A batch writes its files under its own number and then one small record that names the current version of every table.
Readers start from a record, so files of a batch that stopped half-way are never seen; the repeated batch replaces them.
"""

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Record:
    """State after a batch. ``days`` leads a ledger day to the batch that wrote its current version; ``seen`` lists the
    versions that make up the table of seen ids, the first one being a whole one; times are microseconds."""

    batch_id: int = -1
    newest: int | None = None
    seen: tuple[int, ...] = ()
    days: dict[str, int] = field(default_factory=dict)
    progress: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    late: int = 0
    #: Bytes of state that the batch had to read.
    state_bytes: int = 0


class Commits:
    """Records of an intake in one folder of any file system that Spark can write, one file per batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self.folder = folder
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _file(self, batch_id: int):
        return self._path(f"{self.folder}/{batch_id}.json")

    def read(self, batch_id: int) -> Record | None:
        """The record of a batch, None before it is committed."""
        at = self._file(batch_id)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Record(**(found | {"seen": tuple(found["seen"])}))

    def latest(self, before: int | None = None) -> Record:
        """The newest record, or the newest one of earlier batches; an empty one if there is none."""
        if before is not None:
            found = self.read(before - 1)  # batches are numbered without gaps: usually no listing is needed
            if found is not None:
                return found
        if not self._fs.exists(self._path(self.folder)):
            return Record()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        ids = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").lstrip("-").isdigit()]
        ids = [i for i in ids if before is None or i < before]
        return self.read(max(ids)) if ids else Record()

    def write(self, record: Record) -> None:
        """Make a record visible: written aside and renamed, so that it is there whole or not at all."""
        aside = self._path(f"{self.folder}/_{record.batch_id}.new")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(asdict(record)), "utf-8"))
        finally:
            out.close()
        if not self._fs.rename(aside, self._file(record.batch_id)) and self.read(record.batch_id) is None:
            raise OSError(f"the record of batch {record.batch_id} could not be put in place")

    def size(self, *paths: str) -> int:
        """Bytes below the given paths."""
        there = [self._path(p) for p in paths]
        return sum(self._fs.getContentSummary(p).getLength() for p in there if self._fs.exists(p))

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def children(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
