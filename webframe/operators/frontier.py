"""The URL frontier: a relation with unique URLs and a status machine. Every operation returns a new frontier.

Uniqueness is by first arrival: a deterministic order decides among rows of a batch, and an anti-join drops known URLs.
Rows are narrow; bodies never enter the frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq long, url string, parent_url string, root_url string, status string, try_count int, level int, inline_level int, link_type string, priority int, post_data string, status_code int, filename string"
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
STATUSES = ("todo", "in_progress", "done", "error", "skipped")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def new_rows(urls: DataFrame) -> DataFrame:
    """Fills the defaults of rows to insert: a row needs ``url`` and ``seq``; the parent and root of a seed are itself."""
    default = {
        "parent_url": F.col("url"), "root_url": F.col("url"), "status": F.lit("todo"), "try_count": F.lit(0), "level": F.lit(0), "inline_level": F.lit(None), "link_type": F.lit(None),
        "priority": F.lit(0), "post_data": F.lit(None), "status_code": F.lit(None), "filename": F.lit(None),
    }
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    return urls.select(*[(F.col(c) if c in urls.columns else default[c]).cast(kinds[c]).alias(c) for c in COLUMNS])


def first_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in ``order``: an aggregate (pre-aggregated before its exchange), not a sort."""
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def insert_new(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows of ``urls`` that are not known yet, first of their URL."""
    batch = first_per(new_rows(urls), "url", F.col("seq"))
    return batch.join(frontier.select("url"), "url", "left_anti").select(*COLUMNS)


def insert(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    return frontier.unionByName(insert_new(frontier, urls))


def replace(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    batch = first_per(new_rows(urls), "url", F.col("seq"))
    return remove(frontier, batch).unionByName(batch)


def remove(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    return frontier.join(urls.select("url").distinct(), "url", "left_anti").select(*COLUMNS)


def check_out(frontier: DataFrame, status: str = "todo", level: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frontier with the rows in progress, those rows). Without a limit a whole wave; else the first by priority."""
    fits = (F.col("status") == status) & (F.lit(True) if level is None else F.col("level") < level)
    if limit is None:
        after = frontier.withColumn("status", F.when(fits, "in_progress").otherwise(F.col("status")))
        return after, frontier.filter(fits).withColumn("status", F.lit("in_progress"))
    out = frontier.filter(fits).orderBy(F.desc("priority"), "seq").limit(limit)
    taken = out.select("url", F.lit(True).alias("__taken"))
    after = frontier.join(taken, "url", "left").withColumn("status", F.when(F.col("__taken"), "in_progress").otherwise(F.col("status"))).select(*COLUMNS)
    return after, out.withColumn("status", F.lit("in_progress"))


def check_in(frontier: DataFrame, results: DataFrame, count_try: bool = True) -> DataFrame:
    """``results``: unique url, new_status, and optionally status_code and filename. Nulls leave a column as it was."""
    names = [c for c in ("status_code", "filename") if c in results.columns]
    r = results.select("url", F.col("new_status").alias("__status"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = frontier.join(r, "url", "left")
    met = F.col("__status").isNotNull()
    change = {"status": F.coalesce("__status", "status"), "try_count": F.col("try_count") + F.when(met & F.lit(count_try), 1).otherwise(0)}
    change |= {c: F.coalesce(f"__{c}", c) for c in names}
    return joined.withColumns(change).select(*COLUMNS)


def update_one(frontier: DataFrame, url: str, **values) -> DataFrame:
    return frontier.withColumns({c: F.when(F.col("url") == url, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def release(frontier: DataFrame) -> DataFrame:
    return frontier.withColumn("status", F.when(F.col("status") == "in_progress", "todo").otherwise(F.col("status")))


def next_status(frontier: DataFrame) -> str | None:
    """``todo`` while there is any, then ``error``; null when the source is exhausted."""
    found = {r["status"] for r in frontier.filter(F.col("status").isin("todo", "error")).groupBy("status").count().collect()}
    return "todo" if "todo" in found else "error" if "error" in found else None


def counts(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count("*").alias("n_urls"), F.count_if((F.col("status") == "todo") & (F.col("level") == 0)).alias("n_root_todo"))


def by_status(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count("*").alias("n"))


def hostnames(frontier: DataFrame) -> DataFrame:
    from webframe.functions.urls import hostname

    return frontier.select(hostname(F.col("url")).alias("hostname")).distinct()


def queued_files(frontier: DataFrame) -> DataFrame:
    return frontier.filter((F.col("status") == "done") & F.col("filename").isNotNull()).select("url", "filename", F.lit("todo").alias("file_status"))


def child_rows(links: DataFrame) -> DataFrame:
    """Rows for links (seq, link, inline, link_type) of parent records (url, level, inline_level, root_url)."""
    inline = F.when(F.col("inline"), F.coalesce("inline_level", F.lit(0)) + 1)
    return links.select(
        "seq", F.col("link").alias("url"), F.col("url").alias("parent_url"), F.coalesce("root_url", "url").alias("root_url"), (F.col("level") + 1).alias("level"), inline.alias("inline_level"), "link_type"
    )


def anti_clobber(paths: DataFrame, path_col: str, *order: Column) -> DataFrame:
    """``name``, ``name.1``, ``name.2`` ... for equal paths."""
    n = F.row_number().over(Window.partitionBy(path_col).orderBy(*order)) - 1
    return paths.withColumn("__n", n).withColumn(path_col, F.when(F.col("__n") == 0, F.col(path_col)).otherwise(F.concat_ws(".", path_col, F.col("__n").cast("string")))).drop("__n")


def get_one(frontier: DataFrame, url: str) -> DataFrame:
    """The record of a URL, or no row: a filter that Parquet's statistics and row groups serve."""
    return frontier.filter(F.col("url") == url)


def contains(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """``urls`` with ``known``, for any number of them."""
    known = frontier.select("url", F.lit(True).alias("__known"))
    return urls.join(known, "url", "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def interned(frontier: DataFrame, columns: tuple[str, ...] = ("url", "parent_url", "root_url")) -> tuple[DataFrame, DataFrame]:
    """(string_id, value) of the distinct strings, and the frontier with their ids in place of the strings. Ids are hashes,
    so that no numbering has to be agreed on and both sides are made by narrow maps; nulls stay."""
    values = frontier.select(F.explode(F.array(*columns)).alias("value")).filter(F.col("value").isNotNull()).distinct()
    ids = frontier.withColumns({c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in columns})
    return values.select(F.xxhash64("value").alias("string_id"), "value"), ids


def restored(strings: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("url", "parent_url", "root_url")) -> DataFrame:
    out = ids
    for c in columns:
        side = strings.select(F.col("string_id").alias("__id"), F.col("value").alias("__value"))
        out = out.join(side, out[c] == side["__id"], "left").withColumn(c, F.col("__value")).drop("__id", "__value")
    return out.select(*ids.columns)


def file_check_out(files: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files (url, filename, file_status) with the queued ones in progress, these with their URL's record)."""
    queued = files.filter(F.col("file_status") == "todo")
    after = files.withColumn("file_status", F.when(F.col("file_status") == "todo", "in_progress").otherwise(F.col("file_status")))
    return after, queued.select("url", F.col("filename").alias("queued_file")).join(frontier, "url")


def file_check_in(files: DataFrame, results: DataFrame) -> DataFrame:
    """``results``: unique url, new_status."""
    new = results.select("url", F.col("new_status").alias("__new"))
    return files.join(new, "url", "left").withColumn("file_status", F.coalesce("__new", "file_status")).select(*files.columns)


def last_seq(frontier: DataFrame) -> DataFrame:
    """The greatest number given so far, -1 for an empty frontier; new rows go on from it."""
    return frontier.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last_seq"))


def numbered_batches(rows: DataFrame, size: int = 1000, *order: Column) -> DataFrame:
    """``batch`` of at most ``size`` rows. Rows are numbered inside partitions of ranges of the order, so no window runs
    over all of them; a partition's last batch may be short."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    inside, where = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("__id", 33)
    return part.withColumn("batch", F.concat_ws("-", where.cast("string"), F.floor(inside / size).cast("string"))).drop("__id")


def evicted(cache: DataFrame, max_items: int, time_col: str = "used_at") -> DataFrame:
    """The rows that stay: the most recently used ones. A top-k, which Spark takes partition by partition."""
    return cache.orderBy(F.desc(time_col)).limit(max_items)


def kept(cache: DataFrame, now: Column, max_items: int, seconds: float, time_col: str = "used_at", *order: Column) -> DataFrame:
    """The rows of a cache bounded in age and in items: the latest ones of those that are younger than ``seconds``."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(time_col).cast("timestamp"))) / 1e6
    return cache.filter(age < seconds).orderBy(F.desc(time_col), *order).limit(max_items)
