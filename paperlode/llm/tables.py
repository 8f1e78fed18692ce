"""Helpers that all operators of this subpackage share."""

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: a word is a run of other characters.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the session names; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paperlode-"))
    return sc.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there: lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fixed_unsized(df: DataFrame) -> DataFrame:
    """As :func:`fixed`, but of unknown size, for a table that a loop carries from round to round.

    A checkpoint keeps the planner's estimate of its size, and that of a join is the product of both sides: over the rounds of
    a loop its digits grow exponentially, until the number alone fills the driver. A table of unknown size starts anew. It is
    never broadcast by estimate; adaptive execution goes by the sizes that were shuffled.
    """
    written = fixed(df)._jdf
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(written.toJavaRDD(), written.schema()), spark)


def word_list(text: Column) -> Column:
    """Words of a text, none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null; long. Only the ends of a text can make an empty piece."""
    plain = F.coalesce(text, F.lit(""))
    pieces = F.split(F.concat(F.lit("x "), plain, F.lit(" x")), "[ \\t\\n\\x0B\\f\\r]+")
    return (F.size(pieces) - 2).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints of steps that nothing refers to any more.

    Spark's cleaner acts when the driver's JVM has collected the objects that stand for them; those that hold others
    go first, so this takes a few rounds.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


#: Bytes of values up to which a table may be broadcast.
BROADCAST_BYTES = 16 << 20


def _bytes(name: str, kind: str) -> Column:
    """Bytes of a value: text as it is, eight for each number, also in arrays."""
    if kind in ("string", "binary"):
        size = F.octet_length(name)
    elif kind.startswith("array<") and not kind.startswith(("array<string", "array<array", "array<struct", "array<map")):
        size = 8 * F.size(name)
    elif kind.startswith(("array", "struct", "map")):
        size = F.octet_length(F.to_json(F.struct(name)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def small(df: DataFrame, rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The table, written once, and marked for broadcast if its counted rows and bytes are within bounds; else joined by shuffle."""
    written = fixed(df)
    size = sum((_bytes(c, t) for c, t in written.dtypes), F.lit(0)).cast("bigint")
    n, total = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(written) if n <= rows and total <= max_bytes else written


class Columns:
    """A table of the caller with its columns numbered, so that no column of an operator can clash with them."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{k}" for k in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name)}")

    def key(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        """The caller's columns with their own names."""
        return df.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(self.names)])


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there is removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
