"""Payload digests, revisits, and the index of archives."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webframe.operators.frontier import first_per

PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CDX_HEADER = " CDX a b m s k S V g u"


@F.pandas_udf(T.StringType())
def base32_of_hex(digests: pd.Series) -> pd.Series:
    """Base 32 of hexadecimal digests; hashing stays in the JVM."""
    return digests.map(lambda x: None if x is None else base64.b32encode(bytes.fromhex(x)).decode(), na_action=None)


def digest_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def add_visits(visits: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """Visits (url, warc_id, payload_digest) are unique by URL: the first one stays."""
    batch = first_per(new.select("url", "warc_id", "payload_digest", *[c for c in ("seq",) if c in new.columns]), "url", *(order or (F.col("warc_id"),)))
    fresh = batch.join(visits.select("url"), "url", "left_anti")
    return visits.select("url", "warc_id", "payload_digest").unionByName(fresh.select("url", "warc_id", "payload_digest"))


def mark_revisits(responses: DataFrame, visits: DataFrame) -> DataFrame:
    """``responses`` (url, payload_digest) with record_type, refers_to, profile and truncated."""
    known = visits.select(F.col("url").alias("__u"), F.col("payload_digest").alias("__d"), F.col("warc_id").alias("refers_to")).dropDuplicates(["__u", "__d"])
    joined = responses.join(known, (F.col("url") == F.col("__u")) & (F.col("payload_digest") == F.col("__d")), "left").drop("__u", "__d")
    again = F.col("refers_to").isNotNull()
    return joined.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "profile": F.when(again, PROFILE), "truncated": F.when(again, "length")})


def first_of_digest(rows: DataFrame, digest_col: str, id_col: str) -> DataFrame:
    """Each row with the least id of its digest: an aggregate joined back, safe where one digest is most of the rows."""
    firsts = rows.groupBy(digest_col).agg(F.min(id_col).alias("first_id"))
    return rows.join(firsts, digest_col)


def offsets(records: DataFrame, file_col: str, size_col: str, *order: Column) -> DataFrame:
    """The offset of each record in its file; files are bounded by rotation, and so are the window's partitions."""
    w = Window.partitionBy(file_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(size_col).over(w), F.lit(0)).cast("long"))


def rotate(records: DataFrame, size_col: str, max_size: int, key: str, *order: Column) -> DataFrame:
    """``file_seq``: a new file once a file holds more than ``max_size``; sequential for each writer.

    A writer's sorted rows stream through, and the state is two numbers; only the first row of each file is decided by
    the rows before it, so no writer is gathered.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in records.dtypes)
    place, own = records.columns.index(size_col), records.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seq, held, begun = None, 0, 0, False
        for batch in batches:
            out = []
            for who, n in zip(batch.column(own).to_pylist(), batch.column(place).to_pylist(), strict=True):
                if not begun or who != writer:
                    writer, seq, held, begun = who, 0, 0, True
                if held > max_size:
                    seq, held = seq + 1, 0
                out.append(seq)
                held += n or 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "file_seq"])

    return records.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kinds}, file_seq int")


def _own_id(kind: str) -> Column:
    """A record's id from its kind and the transaction's key."""
    digits = F.md5(F.concat_ws(":", F.lit(kind), F.col("key").cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _bytes_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def _records(transactions: DataFrame, carried: tuple[str, ...], *each: tuple[str, Column, Column, Column, str]) -> DataFrame:
    one = lambda kind, to, block, offset, media: F.struct(_own_id(kind).alias("id"), F.lit(kind).alias("record_type"), to.alias("concurrent_to"), F.col("url"), block.alias("block"), offset.cast("int").alias("payload_offset"), F.lit(media).alias("content_type"))
    return transactions.select("key", *carried, F.explode(F.array(*[one(*x) for x in each])).alias("r")).select("key", *carried, "r.*")


def exchange_records(transactions: DataFrame, *carried: str) -> DataFrame:
    """(key, carried columns, id, record_type, concurrent_to, url, block, payload_offset, content_type): a request and a
    response record for each of ``transactions`` (key, url, request_head, response_head, body); the response names its
    request. Keys tell fetches apart, of one URL too."""
    none = F.lit(None).cast("string")
    return _records(
        transactions, carried,
        ("request", none, _bytes_of("request_head"), F.lit(None), "application/http;msgtype=request"),
        ("response", _own_id("request"), F.concat(_bytes_of("response_head"), _bytes_of("body")), F.octet_length(_bytes_of("response_head")), "application/http;msgtype=response"),
    )


def ftp_records(transfers: DataFrame, *carried: str) -> DataFrame:
    """The same columns for ``transfers`` (key, url, conversation, body): the lines of the control connection as metadata, and
    the file as a resource that names them."""
    return _records(
        transfers, carried,
        ("metadata", F.lit(None).cast("string"), _bytes_of("conversation"), F.lit(None), "text/x-ftp-control-conversation"),
        ("resource", _own_id("metadata"), _bytes_of("body"), F.lit(None), "application/octet-stream"),
    )


def file_name(prefix: str, seq: Column, compress: bool = True) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(seq.cast("string"), 5, "0"), F.lit(".warc.gz" if compress else ".warc"))


def cdx_lines(index: DataFrame) -> DataFrame:
    """One line for each response: url, time, mime, code, digest, size, offset, file, record id."""
    cells = ("url", "ts", "mime", "code", "digest", "size", "offset", "file", "record_id")
    return index.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cells]).alias("line"))


def control_conversation(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """The lines of each control connection: ``* `` for notes, ``> `` for commands, ``< `` for replies, which may have several
    lines. A connection is as long as one fetch."""
    mark = F.when(F.col("kind") == "command", "> ").when(F.col("kind") == "reply", "< ").otherwise("* ")
    lines = F.array_join(F.transform(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n"), lambda x: F.concat(mark, x)), "\r\n")
    placed = events.select(key, F.struct(F.struct(*order).alias("o"), lines.alias("line")).alias("x"))
    return placed.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\r\n").alias("block"))
