"""Optional streaming forms: discovered links into the frontier, counts over event time, and keys seen a while ago."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webframe.operators import frontier as fr


def stream_links_into(links: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch's new URLs are appended to the frontier folder once: a batch writes its own sub-folder, so that a
    batch that is run again overwrites what it wrote."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{folder}/batch={number}"
        known = spark.read.schema(fr.SCHEMA + ", batch long").parquet(folder).filter(F.col("batch") < number) if number else fr.empty(spark)
        fr.insert_new(known.select(*fr.COLUMNS), batch).write.mode("overwrite").parquet(path)

    return links.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fetch_rates(events: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and bytes of fetch events for each window and status; works on streams and batches."""
    rows = events.withColumn("__t", F.col(time_col).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if events.isStreaming else rows
    return rows.groupBy(F.window("__t", window).alias("w"), "status").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select(F.col("w.start").alias("window_start"), "status", "n", "size")


def first_within(events: DataFrame, key: str, time_col: str, ttl: str) -> DataFrame:
    """The events of a stream whose key wasn't seen for ``ttl`` of event time: a cache with a time to live as a state that
    Spark expires by the watermark."""
    return events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", ttl).dropDuplicatesWithinWatermark([key]).drop("__t")
