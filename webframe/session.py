"""Session and table helpers shared by every part of the library."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/webframe"


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("webframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only where none is set and the session is local."""
    jsc = spark.sparkContext._jsc.sc()
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = jsc.getCheckpointDir()
    if current.isEmpty():
        if not conf and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(conf or DEFAULT_CHECKPOINT_DIR)
        current = jsc.getCheckpointDir()
    return conf or current.get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What queries that are made inside have shuffled is deleted when they end, and not when the driver happens to collect
    its garbage: iterations would else leave each round's files behind. For frames that are cut, or used once."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that are run inside send Python workers so many rows at once. Spark's own 10,000 are 10,000 texts or sets, which
    the JVM's writer, the worker and what it makes of them hold several times over. For frames that are cut."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


#: Estimates from here on are Catalyst's default for frames whose size it doesn't know, not sizes.
_UNKNOWN_BYTES = 1 << 52


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (file sizes for scans). Where it has none, one pass adds up the rows' strings."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:  # products over joins of unknown frames have more digits than Python reads
        size = _UNKNOWN_BYTES
    if size < _UNKNOWN_BYTES:
        return size
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    row = F.lit(8 * len(df.columns)) + sum(texts, F.lit(0))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)
