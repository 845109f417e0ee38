"""Where documents are saved, and whether."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import naming as N
from webframe.functions import text as X
from webframe.operators.frontier import anti_clobber
from webframe.session import cut


def with_paths(documents: DataFrame, config: CrawlConfig, url_col: str = "url", type_col: str | None = None, body_col: str | None = None) -> DataFrame:
    """Adds ``path`` by the naming options."""
    c = config
    path = N.file_path(F.col(url_col), c.directory_prefix, c.use_directories, c.cut_dirs, c.protocol_directories, c.host_directories, c.default_page)
    if c.adjust_extension:
        kind, body = (F.col(x) if x else F.lit(None).cast("string") for x in (type_col, body_col))
        path = N.adjust_extension(path, X.is_html(kind, body, F.lit("")), X.is_css(kind, body, F.lit("")))
    return documents.withColumn("path", path)


def ignore_existing(documents: DataFrame, existing: DataFrame) -> DataFrame:
    return documents.join(existing.select("path").distinct(), "path", "left_anti")


def anti_clobbered(documents: DataFrame, *order: Column) -> DataFrame:
    return anti_clobber(documents, "path", *order)


def newer_only(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Documents whose last_modified is later than that of the file they would replace."""
    held = existing.groupBy("path").agg(F.max("last_modified").alias("__held"))
    return documents.join(held, "path", "left").filter(F.col("__held").isNull() | (F.col("last_modified") > F.col("__held"))).drop("__held")


def anti_clobber_dirs(paths: DataFrame, files: DataFrame, suffix: str = ".d") -> DataFrame:
    """The first directory of a path that is a file gets the suffix. Prefixes are exploded and met by an equi-join."""
    parts = F.split("dir_path", "/")
    prefixes = paths.select("dir_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix")))).alias("x")).select("dir_path", "x.*")
    hit = prefixes.join(files.select(F.col("path").alias("prefix")).distinct(), "prefix", "left_semi").groupBy("dir_path").agg(F.min("i").alias("__i"))
    fixed = F.array_join(F.transform(parts, lambda p, i: F.when(i + 1 == F.col("__i"), F.concat(p, F.lit(suffix))).otherwise(p)), "/")
    return paths.join(hit, "dir_path", "left").withColumn("safe_dir", F.when(F.col("__i").isNull(), F.col("dir_path")).otherwise(fixed)).drop("__i")


def single_document(documents: DataFrame, folder: str, body_col: str, *order: Column) -> DataFrame:
    """All bodies, byte by byte and nothing between them, as one document in parts: (name, size) of the files below
    ``folder``, which give the document when put together by name. Rows are sorted in ranges and each task writes its own
    part, first under a name of the attempt; a part that is made again is the same."""
    import uuid

    import pyarrow as pa

    from webframe.sources.warc import _store

    def run(batches):
        from pyspark import TaskContext

        store, path = _store(folder)
        part, size = f"part-{TaskContext.get().partitionId():05d}", 0
        store.create_dir(path, recursive=True)
        held = f"{path}/_{part}-{uuid.uuid4().hex}"
        with store.open_output_stream(held, compression=None) as out:
            for batch in batches:
                for body in batch.column(0):
                    size += out.write(body.as_py() or b"")
        store.move(held, f"{path}/{part}")
        yield pa.RecordBatch.from_pylist([{"name": part, "size": size}], pa.schema([("name", pa.string()), ("size", pa.int64())]))

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = documents.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(placed.select(F.col(body_col).cast("binary").alias("body")).mapInArrow(run, "name string, size long"))


def continues(code: Column) -> Column:
    """Whether a response to a partial request may be appended."""
    return code == 206


def with_headers(head: Column, body: Column) -> Column:
    """The bytes of a head, an empty line if it doesn't end with one, and the body."""
    head = F.coalesce(head.cast("binary"), F.lit(b""))
    return F.concat(head, F.when(F.endswith(head, F.lit(b"\r\n\r\n")), F.lit(b"")).otherwise(F.lit(b"\r\n")), body.cast("binary"))


def discard(documents: DataFrame) -> None:
    """Runs all that leads to the documents and keeps none of it."""
    documents.write.format("noop").mode("overwrite").save()


def stamped(documents: DataFrame, header_col: str = "last_modified", fetched_col: str = "fetched_at") -> DataFrame:
    """``modified``: the time of a Last-Modified header that can be read, else the time of the fetch."""
    return documents.withColumn("modified", F.coalesce(X.http_date(F.col(header_col)), F.col(fetched_col).cast("timestamp")))


def write_documents(documents: DataFrame, folder: str, body_col: str = "body", overwrite: bool = True) -> None:
    """The documents as a table by path. Object stores have no files that many tasks could each name safely, so a path is
    a column: :func:`read_document` finds one by Parquet's statistics, as rows are sorted by it in ranges."""
    rows = documents.select("path", F.col(body_col).cast("binary").alias("body"))
    rows.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite" if overwrite else "append").parquet(folder)


def read_document(spark, folder: str, path: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("path") == path)


def appended(held: DataFrame, parts: DataFrame, *order: Column) -> DataFrame:
    """``held`` (path, body) with the bodies of partial responses (path, code, body) behind, all of a path by ``order`` and of
    equal order by their bytes; other responses are errors and change nothing. The parts of a path are one file."""
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.coalesce("body", F.lit(b"")).alias("body"))
    more = parts.filter(continues(F.col("code"))).groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("__more"))
    joined = F.aggregate("__more", F.coalesce("body", F.lit(b"")), lambda a, x: F.concat(a, x["body"]))
    return held.join(more, "path", "left").withColumn("body", F.when(F.col("__more").isNull(), F.col("body")).otherwise(joined)).drop("__more")
