"""Seed URLs and the stores of frontier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions import urls as U
from webframe.operators import frontier as fr
from webframe.operators.extract import html_links


def seeds(spark: SparkSession, urls: list[str] = (), text_path: str | None = None, base: str | None = None) -> DataFrame:
    """(seq, url) of arguments and the lines of text files, canonical, without the invalid ones."""
    rows = spark.createDataFrame([(u,) for u in urls], "value string")
    if text_path:
        rows = rows.unionByName(spark.read.text(text_path).select(F.trim("value").alias("value")).filter("value != ''"))
    if base:
        rows = rows.withColumn("value", U.urljoin(F.lit(base), "value"))
    parsed = rows.withColumn("info", U.url_info("value")).filter(F.col("info.url").isNotNull())
    return parsed.select(F.monotonically_increasing_id().alias("seq"), F.col("info.url").alias("url"))


def seeds_from_html(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Seeds from every link of local HTML files, against one base, or without one against each file's own URL. They are
    numbered in the order of files and links."""
    own = F.col("_metadata.file_path")
    pages = spark.read.text(path, wholetext=True).select(own.alias("file"), (F.lit(base) if base else own).alias("url"), F.col("value").alias("html"))
    links = html_links(pages, key="file").orderBy("file", "ordinal")
    return links.select(F.monotonically_increasing_id().alias("seq"), F.col("link").alias("url"))


def save_frontier(frontier: DataFrame, folder: str, version: int) -> str:
    """A versioned snapshot, partitioned by status so that check-out reads its rows alone."""
    path = f"{folder}/v={version}"
    frontier.write.mode("overwrite").partitionBy("status").parquet(path)
    return path


def load_frontier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(fr.SCHEMA).parquet(path).select(*fr.COLUMNS)


def save_frontier_jdbc(frontier: DataFrame, url: str, name: str = "queued_urls", **properties) -> None:
    frontier.write.jdbc(url, name, mode="overwrite", properties=properties)


def load_frontier_jdbc(spark: SparkSession, url: str, name: str = "queued_urls", **properties) -> DataFrame:
    return spark.read.jdbc(url, name, properties=properties).select(*fr.COLUMNS)
