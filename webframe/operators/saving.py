"""What becomes of a crawl's documents: a series of steps in order, of which the configuration leaves some out.

``documents``: url, status_code, content_type, disposition, last_modified, fetched_at, request_head, response_head, body
(binary). Each step is one plan over all documents and writes a table or archives below the folder; a step that stops
the series leaves what the steps before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import naming as N
from webframe.functions import text as X
from webframe.functions import urls as U
from webframe.operators import archive as A
from webframe.operators import convert, writers
from webframe.sources import cdx, warc


def named(documents: DataFrame, config: CrawlConfig) -> DataFrame:
    """Adds ``path``: by the naming options, the name of a Content-Disposition if it is wanted, and safe on the system."""
    rules = config.restrict_file_names
    options = dict(os_type="windows" if "windows" in rules else "unix", no_control="nocontrol" not in rules, ascii_only="ascii" in rules, case="lower" if "lower" in rules else "upper" if "upper" in rules else None, max_length=config.max_filename_length)
    text = X.inflated_text(F.col("body"))
    rows = writers.with_paths(documents.withColumn("__text", text), config, "url", "content_type", "__text").drop("__text")
    if config.content_disposition:
        given = N.content_disposition(F.col("disposition"))
        folder = F.regexp_extract("path", "^(.*/)?", 1)
        rows = rows.withColumn("path", F.when(given.isNull(), F.col("path")).otherwise(F.concat(folder, given)))
    safe = U.str_udf(lambda p: "/".join(x if x in (".", "") else N.safe_name(x, **options) for x in p.split("/")))
    return rows.withColumn("path", safe(F.col("path")))


def save_files(documents: DataFrame, config: CrawlConfig, folder: str) -> DataFrame:
    """The documents as files by path, of equal paths with numbers, or as one document by time and URL, their response
    heads in front if these are wanted; nothing is kept where files are deleted after."""
    rows = writers.anti_clobbered(writers.stamped(named(documents, config)), F.col("url"))
    body = writers.with_headers(F.col("response_head"), F.col("body")) if config.save_headers else F.col("body")
    saved = rows.withColumn("body", body)
    if config.delete_after:
        writers.discard(saved)
    elif config.output_document:
        writers.single_document(saved, f"{folder}/document", "body", F.col("fetched_at"), F.col("url"))
    else:
        writers.write_documents(saved, f"{folder}/files")
    return rows


def convert_links(rows: DataFrame, config: CrawlConfig, folder: str) -> None:
    """HTML and CSS with their links converted, and under ``backup_converted`` the documents as they were too."""
    kind = F.when(F.col("content_type").contains("html"), "html").when(F.col("content_type").contains("css"), "css")
    texts = rows.select("url", kind.alias("kind"), F.col("path").alias("filename"), F.col("body").cast("string").alias("body")).filter(F.col("kind").isNotNull())
    saved = rows.select("url", F.lit("done").alias("status"), F.col("path").alias("filename"))
    done = convert.convert_documents(texts, saved)
    out = done.select(F.col("filename").alias("path"), F.col("converted").alias("body"))
    if config.backup_converted:
        out = out.unionByName(done.select(F.concat("filename", F.lit(".orig")).alias("path"), "body"))
    writers.write_documents(out, f"{folder}/converted")


def _warc_date(time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def warc_rows(records: DataFrame) -> DataFrame:
    """``records`` (of :func:`archive.exchange_records` or :func:`archive.ftp_records` with date, and refers_to for revisits) as
    rows that the WARC source writes. The writer adds the time of its job where there is no date."""
    again = F.col("refers_to").isNotNull()
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    fields = F.array(
        field("WARC-Type", F.when(again, "revisit").otherwise(F.col("record_type"))), field("WARC-Record-ID", F.col("id")), field("WARC-Date", F.col("date")), field("WARC-Target-URI", F.col("url")),
        field("WARC-Concurrent-To", F.col("concurrent_to")), field("WARC-Refers-To", F.col("refers_to")), field("WARC-Profile", F.when(again, F.lit(A.PROFILE))),
        field("WARC-Truncated", F.when(again, F.lit("length"))), field("Content-Type", F.col("content_type")),
    )
    block = F.when(again, F.expr("substring(block, 1, payload_offset)")).otherwise(F.col("block"))
    return records.select(F.filter(fields, lambda x: x["value"].isNotNull()).alias("fields"), block.alias("block"), "payload_offset")


def save_archives(documents: DataFrame, config: CrawlConfig, folder: str, visits: DataFrame | None = None, transfers: DataFrame | None = None) -> None:
    """WARC files of all exchanges, rotated by size; with ``warc_dedup`` responses that ``visits`` know are revisits
    without a payload, and with ``warc_cdx`` an index of the written responses. Each fetch has ids of its own.
    ``transfers`` (url, fetched_at, conversation, body) are fetches over FTP."""
    dated = lambda rows, *columns: rows.select(F.expr("uuid()").alias("key"), "url", _warc_date(F.col("fetched_at")).alias("date"), *columns)
    records = A.exchange_records(dated(documents, "request_head", "response_head", "body"), "date")
    unknown = F.lit(None).cast("string")
    if config.warc_dedup and visits is not None:
        payload = F.expr("substring(block, payload_offset + 1)")
        records = records.withColumn("payload_digest", F.when(F.col("record_type") == "response", A.digest_base32(payload)))
        known = visits.select(F.col("url").alias("__u"), F.col("payload_digest").alias("__d"), F.col("warc_id").alias("refers_to")).dropDuplicates(["__u", "__d"])
        records = records.join(known, (F.col("url") == F.col("__u")) & (F.col("payload_digest") == F.col("__d")), "left").drop("__u", "__d", "payload_digest")
    else:
        records = records.withColumn("refers_to", unknown)
    if transfers is not None:
        records = records.unionByName(A.ftp_records(dated(transfers, "conversation", "body"), "date").withColumn("refers_to", unknown))
    warc.write_warc(warc_rows(records), f"{folder}/archives", max_size=config.warc_max_size or 0)
    if config.warc_cdx:
        index_archives(records.sparkSession, f"{folder}/archives", f"{folder}/cdx")


def archive_index(spark, archives: str) -> DataFrame:
    """The columns of a CDX for the responses of archives that are there: offset and size are those of a record's own gzip
    member, and the time is the record's in seconds."""
    read = warc.read_warc(spark, archives).filter(F.col("type") == "response")
    digest = F.get(F.filter("fields", lambda f: f["name"] == "WARC-Payload-Digest"), F.lit(0))["value"]
    text = F.col("block").cast("string")
    return read.select(
        "url", F.unix_timestamp("date", "yyyy-MM-dd'T'HH:mm:ssX").alias("ts"), X.mimetype(F.regexp_extract(text, r"(?im)^content-type:\s*([^\r\n]*)", 1)).alias("mime"), X.response_line(text)["code"].alias("code"),
        F.regexp_replace(digest, "^sha1:", "").alias("digest"), F.col("length").alias("size"), "offset", F.regexp_extract("file", "([^/]*)$", 1).alias("file"), F.col("id").alias("record_id"),
    )


def index_archives(spark, archives: str, folder: str) -> None:
    """Writes the CDX of archives."""
    cdx.write_cdx(archive_index(spark, archives), folder)


def series(config: CrawlConfig, visits: DataFrame | None = None) -> list[tuple[str, Callable]]:
    """(name, step) in order; a step takes the documents, or what ``files`` made of them, and the folder."""
    steps = [("archives", lambda docs, rows, folder: save_archives(docs, config, folder, visits)), ("files", lambda docs, rows, folder: save_files(docs, config, folder))]
    if config.convert_links and not config.delete_after and not config.output_document:
        steps.append(("conversion", lambda docs, rows, folder: convert_links(rows, config, folder)))
    return steps


def finish(documents: DataFrame, config: CrawlConfig, folder: str, visits: DataFrame | None = None, stop_before: str | None = None) -> list[str]:
    """Runs the series and returns the names of the steps that ran."""
    ran, rows = [], None
    for name, step in series(config, visits):
        if name == stop_before:
            break
        rows = step(documents, rows, folder) or rows
        ran.append(name)
    return ran
