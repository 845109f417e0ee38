"""Crawl statistics, and the windows that rate limits, back-off and stalls are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 20


def totals(done: DataFrame, size_col: str = "size", time_col: str = "ts") -> DataFrame:
    """files, bytes and duration in seconds."""
    seconds = F.unix_micros(F.max(F.col(time_col).cast("timestamp"))) - F.unix_micros(F.min(F.col(time_col).cast("timestamp")))
    return done.agg(F.count("*").alias("files"), F.sum(size_col).cast("long").alias("size"), (seconds / 1e6).alias("duration"))


def quota_exceeded(done: DataFrame, frontier: DataFrame, quota: int, size_col: str = "size") -> DataFrame:
    """Whether the bytes reach the quota and no seed is left to do; two one-row aggregates."""
    size = done.agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("size"))
    left = frontier.agg(F.count_if((F.col("status") == "todo") & (F.col("level") == 0)).alias("left"))
    return size.crossJoin(left).select(((F.col("size") >= quota) & (F.col("left") == 0)).alias("exceeded"))


def quota_reached_at(results: DataFrame, key: str, quota: int, size_col: str, *order: Column) -> DataFrame:
    """Running bytes of each key and whether they reach the quota."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("running", F.sum(size_col).over(w)).withColumn("reached", F.col("running") >= quota)


def speed(samples: DataFrame, key: str, bytes_col: str, seconds_col: str, *order: Column) -> DataFrame:
    """Bytes a second over each key's last 20 samples; 0 where they took no time."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(SAMPLES - 1), 0)
    b, s = F.sum(bytes_col).over(w), F.sum(seconds_col).over(w)
    return samples.withColumn("speed", F.when(s > 0, b / s).otherwise(0.0))


def sleep_time(samples: DataFrame, key: str, limit: float, bytes_col: str, seconds_col: str, *order: Column) -> DataFrame:
    """Seconds to wait to keep to ``limit`` bytes a second over the last 20 samples; under a millisecond is none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(SAMPLES - 1), 0)
    rest = F.sum(bytes_col).over(w) / F.lit(float(limit)) - F.sum(seconds_col).over(w)
    return samples.withColumn("sleep", F.when(rest < 0.001, 0.0).otherwise(rest))


def backoff(results: DataFrame, key: str, failed: Column, wait: float, max_wait: float, *order: Column) -> DataFrame:
    """Waits after each result: one more for each error since the last success, up to the most."""
    w = Window.partitionBy(key).orderBy(*order)
    island = results.withColumn("__failed", failed).withColumn("__island", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    errors = F.sum(F.col("__failed").cast("int")).over(Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("wait", F.least(F.lit(float(max_wait)), F.lit(float(wait)) + errors)).drop("__failed", "__island")


def stalls(samples: DataFrame, key: str, time_col: str, bytes_col: str, seconds: float = 5.0) -> DataFrame:
    """Whether no bytes came for ``seconds`` or more before each sample; once stalled a key stays so."""
    w = Window.partitionBy(key).orderBy(time_col)
    last = F.last(F.when(F.col(bytes_col) > 0, F.unix_micros(F.col(time_col).cast("timestamp"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.unix_micros(F.col(time_col).cast("timestamp")) - last) / 1e6 >= seconds
    return samples.withColumn("__gap", F.coalesce(gap, F.lit(False))).withColumn("stalled", F.max("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")


class SampleFold:
    """What the feeds of one key have come to so far: a state of four numbers, fed in the order of time."""

    def __init__(self, least: float = 0.15, stall: float = 5.0):
        self.least, self.stall = least, stall
        self.begin: int | None = None
        self.held, self.stalled = 0, False

    def feed(self, t: int, n: int) -> tuple[float, int, bool] | None:
        """(seconds, bytes, stalled) if a feed of n bytes at t microseconds ends a sample."""
        self.begin = t if self.begin is None else self.begin
        self.held += n
        seconds = (t - self.begin) / 1e6
        if seconds < self.least:
            return None
        self.begin = t
        if n == 0 and seconds >= self.stall:
            self.stalled = True
            return None
        out = (seconds, self.held, self.stalled)
        self.held = 0
        return out


def merge_samples(feeds: DataFrame, key: str, time_col: str, bytes_col: str, least: float = 0.15, stall: float = 5.0) -> DataFrame:
    """Samples (key, seconds, n, stalled) of at least ``least`` seconds each, from feeds of bytes. A feed without bytes
    after ``stall`` seconds or more makes no sample and stalls its key: samples after it say so. Sequential in a key: its
    sorted feeds stream through a state of four numbers, and no key is gathered."""
    import pyarrow as pa

    kind = dict(feeds.dtypes)[key]

    def run(batches):
        last, begun, state = None, False, None
        for batch in batches:
            place, rows = [], []
            for i, (k, t, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if not begun or k != last:
                    last, begun, state = k, True, SampleFold(least, stall)
                if made := state.feed(t, n or 0):
                    place.append(i)
                    rows.append(made)
            seconds, size, stalled = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(seconds, pa.float64()), pa.array(size, pa.int64()), pa.array(stalled, pa.bool_())], names=["k", "seconds", "n", "stalled"])

    flat = feeds.select(F.col(key).alias("k"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"), F.col(bytes_col).cast("long").alias("n"))
    placed = flat.repartition("k").sortWithinPartitions("k", "t", "n")
    return placed.mapInArrow(run, f"k {kind}, seconds double, n long, stalled boolean").withColumnRenamed("k", key)


def link_counts(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(key).agg(F.count_if("inline").alias("n_inline"), F.count_if(~F.col("inline")).alias("n_linked"))


def link_sets(links: DataFrame, key: str) -> DataFrame:
    pick = lambda c: F.sort_array(F.collect_set(F.when(F.col(c), F.col("link"))))
    return links.groupBy(key).agg(pick("inline").alias("inline_links"), pick("linked").alias("linked_links"))
