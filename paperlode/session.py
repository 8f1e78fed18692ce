"""Spark session helpers and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "paperlode", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A machine-local folder is used only where the setting is absent and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="paperlode-"))
    return sc.getCheckpointDir()


def new_work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared working folder; what is written there is removed when the session's JVM ends."""
    path = f"{work_root(spark)}/paperlode/{name}-{uuid.uuid4().hex[:12]}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The written table cuts the lineage: later steps neither repeat the work nor depend on executors
    that did it.
    """
    path = new_work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the session has cores; others stay as they are.

    For text work that costs far more than moving the rows. A large table has enough splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
