"""WARC archives of transactions: writing through Spark's own file committer, reading, and assembly of captures.

A capture is three records: request, response (or revisit) and metadata; response and metadata name the request in
WARC-Concurrent-To. Records are written as lines of a text file whose line separator is the CRLFCRLF that ends every
record, so the files are plain WARC/1.0, go to any file system that Spark writes, and appear by task commit alone.
Of captures with equal payloads of MIN_REVISIT bytes or more, the one with the largest id keeps the payload, and the
others are revisits that refer to it. That choice is an aggregate over (digest, id), joined back to the revisits alone.

Files are bounded in bytes: captures are written by classes of payload size, each with its own most records for a file.
Reading takes whole files, splits them by Content-Length, and gives one row for each record; assembly joins records by
the identifiers that they name as concurrent, whatever files they are in and however the names are chained, and emits
one nested row per capture. The identifiers derive from id and payload, so a retried task writes the same bytes; rows
that share both get random ones besides.

Defined results: a null payload is empty; rows whose id is null or repeated are captures of their own, and an id that
has several payloads is judged by each of them; of equal payloads all rows with the largest id are responses, and so are
those with a null id; records without a known request are captures without one; blocks may hold any bytes; an archive
that is cut or malformed gives the records before that place and then one of type ``damaged``; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm.components import components
from webframe.session import checkpoint_dir, cut

MIN_REVISIT = 1000
#: (payloads up to so many bytes, most captures in a file): files hold about 100 MB at most, or one capture
SIZE_CLASSES = ((1 << 16, 1500), (1 << 20, 100), (1 << 62, 1))
SENT_BYTES = 32 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record_id(kind: str, capture: Column) -> Column:
    """A stable urn:uuid made from the kind and the capture's key."""
    h = F.md5(F.concat_ws(":", F.lit(kind), capture).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, own: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    """Head and block of a record without the CRLFCRLF at its end. Null fields are left out."""
    lines = [F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), own)]
    lines += [F.concat(F.lit(name + ": "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def captures(pages: DataFrame, key: str, url_col: str, body_col: str) -> DataFrame:
    """(key, page, url, payload, digest) of every row."""
    payload = F.coalesce(F.col(f"`{body_col}`").cast("binary"), F.lit(b""))
    url = F.coalesce(F.regexp_replace(F.col(f"`{url_col}`"), r"[\r\n]", ""), F.lit(""))
    return pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{key}`").cast("string").alias("page"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))


def plan(rows: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(digest, page, first, again): the captures that differ from the rule, a response of its own identifier. ``first``
    names the id that keeps the payload of a revisit; ``again`` tells that several rows have this id and payload, and
    ``firsts`` that several keep it. Payloads are not shuffled."""
    narrow = rows.select("digest", "key", "page", (F.octet_length("payload") >= min_bytes).alias("long"))
    pairs = narrow.groupBy("digest", "key", "page", "long").agg(F.count("*").alias("n"))
    last = pairs.filter("long").groupBy("digest").agg(F.max(F.struct("key", "page", "n")).alias("f"), F.sum("n").alias("rows")).filter("rows > 1")
    met = pairs.join(last, "digest", "left")
    first = F.when(F.col("long") & (F.col("key") < F.col("f.key")), F.col("f.page"))
    marked = met.select("digest", "page", first.alias("first"), (F.col("n") > 1).alias("again"), (F.col("f.n") > 1).alias("firsts"))
    return marked.filter(F.col("first").isNotNull() | F.col("again")).withColumnsRenamed({"digest": "p_digest", "page": "p_page"})


def records(rows: DataFrame, planned: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``record``: three records for each of the captures ``rows``."""
    same = (rows["digest"] == planned["p_digest"]) & rows["page"].eqNullSafe(planned["p_page"])
    rows = rows.join(planned, same, "left")
    name = F.concat_ws(":", F.coalesce("page", F.lit("null")), "digest")
    rows = rows.withColumn("capture", F.when(F.col("again"), F.concat_ws(":", name, F.uuid())).otherwise(name))
    text = F.col("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.lit(END))
    capture, again = F.col("capture"), F.col("first").isNotNull()
    request, answer = record_id("request", capture), record_id("response", capture)
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    keeper = F.when(~F.col("firsts"), record_id("response", F.concat_ws(":", "first", "digest")))  # one of several has no known name
    common = (("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date)), ("X-Capture-Key", F.col("page")))
    asked = _record(F.lit("request"), request, ask, *common, ("Content-Type", F.lit("application/http;msgtype=request")))
    answered = _record(
        F.when(again, "revisit").otherwise("response"), answer, F.when(again, head).otherwise(F.concat(head, text)), *common,
        ("WARC-Concurrent-To", request), ("WARC-Payload-Digest", digest), ("X-Payload-Length", F.octet_length("payload").cast("string")),
        ("WARC-Profile", F.when(again, PROFILE)), ("WARC-Refers-To", F.when(again, keeper)), ("X-Refers-To-Key", F.col("first")),
        ("WARC-Truncated", F.when(again, "length")), ("Content-Type", F.lit("application/http;msgtype=response")),
    )
    note = _record(F.lit("metadata"), record_id("metadata", capture), F.lit("outlinks: 0"), *common, ("WARC-Concurrent-To", request), ("Content-Type", F.lit("application/warc-fields")))
    return rows.select(F.explode(F.array(asked, answered, note)).alias("record"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Archives of all rows below ``folder``, one folder for each size class that has rows."""
    rows = captures(pages, key, url_col, body_col)
    planned = cut(plan(rows))
    # its rows are few and short where captures differ; sent if they are, or else payloads would be shuffled to meet them
    told = planned.agg(F.count("*"), F.sum(F.octet_length("p_digest") + F.octet_length(F.coalesce("p_page", F.lit(""))) + F.octet_length(F.coalesce("first", F.lit(""))))).first()
    if 64 * told[0] + (told[1] or 0) <= SENT_BYTES:
        planned = F.broadcast(planned)
    size = F.octet_length("payload")
    least = (-1, *(n for n, _ in SIZE_CLASSES))
    inside = [(size > a) & (size <= b) for a, (b, _) in zip(least, SIZE_CLASSES, strict=False)]
    counts = rows.agg(*[F.count_if(x) for x in inside]).first()
    for k, (n, (_, most)) in enumerate(zip(counts, SIZE_CLASSES, strict=True)):
        if n or not any(counts) and not k:  # an empty table writes an empty archive
            out = records(rows.filter(inside[k]), planned).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", 3 * most).option("compression", "gzip")
            out.text(f"{folder}/class={k}")


FIELDS = "type string, id string, concurrent_to array<string>, uri string, capture_key string, digest string, payload_length long, refers_to_key string, content_type string, http_head string, payload binary"
_HEAD = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


class Damaged(ValueError):
    """An archive that is cut or malformed, from the byte ``at`` on."""

    def __init__(self, why: str, at: int):
        super().__init__(f"{why} at byte {at}")
        self.at = at


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """(values by lower-case field name, block) of each record; raises Damaged where a file is cut or malformed."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or stop < 0:
            raise Damaged("no record", at)
        fields: dict[str, list[str]] = {}
        for k, v in _HEAD.findall(data[at : stop + 2]):
            fields.setdefault(k.decode("latin-1").lower(), []).append(v.decode("utf-8", "replace"))
        size = fields.get("content-length", [""])[0]
        begin = stop + 4
        if not size.isdigit() or data[begin + int(size) : begin + int(size) + 4] != b"\r\n\r\n":
            raise Damaged("a record that doesn't end where its length says", at)
        yield fields, view[begin : begin + int(size)]
        at = begin + int(size) + 4


def _inflate(raw: bytes) -> tuple[bytes, bool]:
    """(content of any number of gzip members, whether they are whole)"""
    import zlib

    if raw[:2] != b"\x1f\x8b":
        return raw, True
    parts: list[bytes] = []
    while raw:
        d = zlib.decompressobj(31)
        try:
            parts.append(d.decompress(raw))
        except zlib.error:
            return b"".join(parts), False
        if not d.eof:
            return b"".join(parts), False
        raw = d.unused_data
    return b"".join(parts), True


def rows_of(raw: bytes) -> Iterator[tuple]:
    """FIELDS of each record of an archive, then a row of type ``damaged`` if it is not whole."""
    data, whole = _inflate(raw)
    try:
        for f, block in parse(data):
            get = lambda name: f.get(name, [None])[0]  # noqa: B023, E731
            http = (get("content-type") or "").startswith("application/http")
            head, payload = ((*bytes(block).split(b"\r\n\r\n", 1), b"")[:2] if http else (b"", bytes(block)))
            length, named = get("x-payload-length"), [x for x in f.get("warc-concurrent-to", []) if x != get("warc-record-id")]
            yield (get("warc-type"), get("warc-record-id"), named, get("warc-target-uri"), get("x-capture-key"), (get("warc-payload-digest") or "").removeprefix("sha1:") or None, int(length) if length and length.isdigit() else None, get("x-refers-to-key"), get("content-type"), head.decode("utf-8", "replace"), payload)
    except Damaged:
        whole = False
    if not whole:
        yield ("damaged", *[None] * 10)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives in ``folder`` and below, with the HTTP head cut off the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in rows_of(data.as_py()):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("content").mapInArrow(run, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.strip().split(" ")[0] for c in FIELDS.split(", ")]
    kinds = {"payload_length": pa.int64(), "payload": pa.binary(), "concurrent_to": pa.list_(pa.string())}
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, cols, strict=True)], names=names)


def captured(rows: DataFrame) -> DataFrame:
    """``rows`` with ``transaction``: the identifier that joins a capture's records.

    Most archives name the request alone. Where a record names one that names others in turn, or names several, the
    records that are joined that way are components of the graph of names.
    """
    rows = rows.filter(F.col("type").isNull() | (F.col("type") != "damaged"))
    named = rows.select("id", F.explode("concurrent_to").alias("to"))
    several = rows.filter(F.size("concurrent_to") > 1).select("id")
    chained = named.join(named.select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("id")
    own = F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("id"))
    if not several.unionByName(chained).limit(1).count():
        return rows.withColumn("transaction", own)
    parts = cut(components(named.select(F.col("id").alias("u"), F.col("to").alias("v"))))
    return rows.withColumn("transaction", own).join(parts, F.col("transaction") == parts["node"], "left").withColumn("transaction", F.coalesce("component", "transaction")).drop("node", "component")


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row per capture, whose response holds all columns of ``rows``. Records meet by their transaction in an
    aggregate, which is the join of all its sides in one exchange; a capture has a handful of records, and revisits share
    payloads, not identifiers, so no group is hot. Records without an identifier are captures of their own."""
    fields = [c for c in rows.columns if c != "concurrent_to"]
    met = captured(rows).withColumn("transaction", F.coalesce("transaction", F.concat_ws(":", F.lit("unnamed"), F.uuid())))
    one = lambda *types: F.first(F.when(F.col("type").isin(*types), F.struct(*fields)), ignorenulls=True)
    return met.groupBy("transaction").agg(one("request").alias("request"), one("response", "revisit").alias("response"), F.collect_list(F.when(F.col("type") == "metadata", F.struct(*fields))).alias("metadata"))


def archive_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
