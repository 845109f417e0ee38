"""Text, number, date and header functions, and document-type tests, as native columns where the rules allow it."""

from __future__ import annotations

import codecs
import gzip
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- link text ----------------------------------------------------------------------------------------------------


def clean_link_soup(link: Column) -> Column:
    """Each line trimmed and without tabs, lines joined."""
    return F.array_join(F.transform(F.split(link, r"\r\n|[\n\r\x0B\x0C]"), lambda x: F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("\t"), F.lit(""))), "")


def parse_refresh(text: Column) -> Column:
    """The URL of a Refresh header or meta element; null without one."""
    url = F.regexp_extract(text, r"(?i)url\s*=(.+)", 1)
    for quote in ('"', "'"):
        url = F.when(url.startswith(quote), F.regexp_replace(url, f"^{quote}+|{quote}+$", "")).otherwise(url)
    return F.when(text.rlike(r"(?i)url\s*=(.+)"), clean_link_soup(url))


# --- numbers, dates, characters -----------------------------------------------------------------------------------


def format_size(n: Column) -> Column:
    """B, KiB, MiB, GiB or TiB with one decimal; exact halves go to the even digit."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = F.format_string("%.1f TiB", F.bround(n / 1024.0**4, 1))
    for k in (3, 2, 1, 0):
        out = F.when((n > -(1024 ** (k + 1))) & (n < 1024 ** (k + 1)), F.format_string(f"%.1f {units[k]}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    return out


def parse_int_grouped(text: Column) -> Column:
    return F.regexp_replace(text, "[ ,]", "").cast("long")


def iso8601_seconds(text: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def http_date(text: Column) -> Column:
    """``Sun, 06 Nov 1994 08:49:37 GMT`` as a timestamp; null for other forms."""
    return F.try_to_timestamp(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))


# --- HTTP heads ---------------------------------------------------------------------------------------------------

# The first lines of responses and requests.
_STATUS = r"^(HTTP/\d+\.\d+)[ \t]+([0-9]{1,3})[ \t]*([^\r\n]*)"
_REQUEST = r"^([a-zA-Z]+)[ \t]+([^ \t]+)[ \t]+(HTTP/\d+\.\d+)"


def response_line(head: Column) -> Column:
    """struct(version, code, reason); null where it isn't one."""
    part = lambda k: F.regexp_extract(head, _STATUS, k)
    return F.when(head.rlike(_STATUS), F.struct(part(1).alias("version"), part(2).cast("int").alias("code"), part(3).alias("reason")))


def request_line(head: Column) -> Column:
    """struct(method, path, version, url): the URL is that of the Host field."""
    part = lambda k: F.regexp_extract(head, _REQUEST, k)
    host = F.regexp_extract(head, r"(?im)^host:[ \t]*([^\r\n]*)", 1)
    return F.when(head.rlike(_REQUEST), F.struct(part(1).alias("method"), part(2).alias("path"), part(3).alias("version"), F.concat(F.lit("http://"), host, part(2)).alias("url")))


def title_case(name: Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere."""
    letters = F.split(F.lower(name), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def header_fields(text: Column, strict: bool = False) -> Column:
    """array<struct<name, value>> in order, folded lines joined; with ``strict`` null if a line has no colon."""
    unfolded = F.regexp_replace(text, r"[ \t]*\r?\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, r"\r?\n"), lambda x: F.trim(x) != "")
    fields = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(title_case(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("value")))
    return F.when(F.forall(lines, lambda x: x.contains(":")), fields) if strict else fields


def header_value(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda x: x["name"] == name), F.lit(0))["value"]


def header_text(fields: Column) -> Column:
    """``Name: value`` lines, each ended by CRLF."""
    line = lambda x: F.when(x["value"] == "", F.concat(x["name"], F.lit(":"))).otherwise(F.concat(x["name"], F.lit(": "), x["value"]))
    return F.concat(F.array_join(F.transform(fields, line), "\r\n"), F.when(F.size(fields) > 0, "\r\n").otherwise(""))


def line_ending(text: Column) -> Column:
    return F.when(F.regexp_count(text, F.lit("\r\n")) >= F.regexp_count(text, F.lit("\n")), "\r\n").otherwise("\n")


def read_strategy(transfer_encoding: Column, content_length: Column) -> Column:
    return F.when(F.coalesce(transfer_encoding, F.lit("")).rlike("(?i)chunked"), "chunked").when(content_length.isNotNull(), "length").otherwise("close")


def has_no_body(method: Column, code: Column, transfer_encoding: Column, content_length: Column) -> Column:
    return transfer_encoding.isNull() & content_length.isNull() & (code.isin(204, 304) | code.between(100, 199) | (F.upper(method) == "HEAD"))


def should_close(version: Column, connection: Column) -> Column:
    c = F.lower(F.coalesce(connection, F.lit("")))
    return F.when(version == "HTTP/1.0", F.replace(c, F.lit("-"), F.lit("")) != "keepalive").otherwise(c == "close")


def charset(header: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(header, r"""(?i)charset[ ]?=[ ]?["']?([a-z0-9_-]+)""", 1)), F.lit(""))


def mimetype(content_type: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(content_type, "^([a-zA-Z0-9-]+/[a-zA-Z0-9-]+)", 1), F.lit("")), F.lit("-"))


# --- document types -----------------------------------------------------------------------------------------------


# What types of documents are known by, in lower case.
HTML_MARKS = "<!doctype html|<head|<title|<html|<script|<table|<a href"
CSS_MARKS = "@import |color:|background[a-z-]*:|font[a-z-]*:"
SCRIPT_MARKS = r"var|function|settimeout|jquery\("
SITEMAP_ROOTS = "<sitemapindex|<urlset"
PEEK = 4096


def _peek(body: Column) -> Column:
    """The printable characters of a document's begin."""
    return printable(F.substring(body, 1, PEEK))


def first_true(*tests: Column) -> Column:
    """Whether the first test that decides says yes. A test decides by true, or by false; null leaves it to the next."""
    return F.coalesce(*tests, F.lit(False))


def _yes(test: Column) -> Column:
    """A test that can only say yes."""
    return F.when(test, True)


def _unless_page(marks: str, text: Column) -> Column:
    """No for pages, whatever else speaks for it; yes if a mark is found."""
    return F.when(text.contains("<html"), False).when(text.rlike(marks), True)


def is_html(content_type: Column, body: Column, url_path: Column) -> Column:
    return first_true(_yes(F.lower(content_type).contains("html")), _yes(F.lower(_peek(body)).rlike(HTML_MARKS)), _yes(F.lower(url_path).rlike(r"\.d?htm|\.xht")))


def _of_mislabelled(word: str, marks: str, end: str, content_type: Column, body: Column, url_path: Column) -> Column:
    """By the media type; by the body only where a page is announced, or nothing is; by the path."""
    kind, text = F.lower(content_type), F.lower(_peek(body))
    looked_at = kind.isNull() | kind.contains("html")
    return first_true(_yes(kind.contains(word)), F.when(looked_at, _unless_page(marks, text)), _yes(F.lower(url_path).contains(end)))


def is_css(content_type: Column, body: Column, url_path: Column) -> Column:
    """A null media type stands for a file without a response."""
    return _of_mislabelled("css", CSS_MARKS, ".css", content_type, body, url_path)


def is_javascript(content_type: Column, body: Column, url_path: Column) -> Column:
    return _of_mislabelled("javascript", SCRIPT_MARKS, ".js", content_type, body, url_path)


def is_xml(content_type: Column, body: Column, url_path: Column) -> Column:
    return first_true(_yes(F.lower(content_type).contains("xml")), _yes(F.lower(_peek(body)).contains("<?xml")), _yes(F.lower(url_path).endswith(".xml")))


def is_sitemap(body: Column, url_path: Column) -> Column:
    """By its begin, in the letters as they are, or by its path. Of bytes that may be gzip take :func:`page_text` first."""
    peek, p = _peek(body), F.lower(url_path)
    return first_true(_yes(peek.contains("<?xml") & peek.rlike(SITEMAP_ROOTS)), _yes((p == "/robots.txt") | (p.contains("sitemap") & p.contains(".xml"))))


def page_text(data: Column) -> Column:
    """The text of bytes, of which only those that begin like gzip go through a worker."""
    zipped = F.startswith(data, F.lit(b"\x1f\x8b"))
    return F.when(zipped, inflated_text(F.when(zipped, data))).otherwise(F.decode(data, "utf-8"))


def inflated_text(data: Column) -> Column:
    """The text of bytes that may be gzip, whole or cut."""
    return F.decode(gunzip_any(data), "utf-8")


# --- bytes --------------------------------------------------------------------------------------------------------


def decode_gzip(data: bytes, truncated: bool = False) -> bytes:
    """Inflates data that start like gzip and passes others through."""
    if data[:2] != b"\x1f\x8b":
        return data
    if not truncated:
        return gzip.decompress(data)
    d = zlib.decompressobj(31)
    return d.decompress(data) + d.flush()


def decode_deflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompress(data, -15)


def decode_chunked(data: bytes) -> bytes:
    """The body of a chunked transfer; raises ValueError where it is cut."""
    out, at = [], 0
    while True:
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("no chunk size")
        size = int(data[at:stop].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        chunk = data[stop + 1 : stop + 1 + size]
        if len(chunk) < size:
            raise ValueError("cut chunk")
        out.append(chunk)
        after = data[stop + 1 + size : stop + 3 + size]
        at = stop + 1 + size + (2 if after == b"\r\n" else 1)


def detect_encoding(data: bytes, hint: str | None = None, html: bool = False) -> str:
    """The first of byte-order mark, hint, declared charset, UTF-8 and Windows-1252 that decodes all of the data (but up
    to three cut bytes at the end of data of over 16 bytes), otherwise Latin-1. ASCII is never named."""
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
    declared = re.search(rb"""<meta[^>]+charset\s*=\s*["']?([a-zA-Z0-9_-]+)|<\?xml[^>]+encoding\s*=\s*["']([a-zA-Z0-9_-]+)""", data[:4096], re.I) if html else None
    names = [n for b, n in marks if data.startswith(b)] + [hint] + ([(declared[1] or declared[2]).decode()] if declared else []) + ["utf-8", "cp1252"]
    for name in filter(None, names):
        try:
            codec = codecs.lookup(name).name
        except LookupError:
            continue
        if codec == "ascii":
            continue
        for cut in range(4 if len(data) > 16 else 1):
            try:
                data[: len(data) - cut].decode(codec)
                return codec
            except UnicodeDecodeError:
                continue
    return "iso8859-1"


def _bytes_udf(f, kind: T.DataType):
    """A function of bodies that gives null where they can't be read. Not by Arrow, whose batches have 10,000 rows and would
    hold as many bodies at once, several times over: rows go to Python by the hundred."""

    def run(x):
        try:
            return None if x is None else f(bytes(x))
        except (ValueError, OSError, EOFError, zlib.error):
            return None

    return F.udf(run, kind, useArrow=False)


gunzip = _bytes_udf(decode_gzip, T.BinaryType())
inflate = _bytes_udf(decode_deflate, T.BinaryType())
unchunk = _bytes_udf(decode_chunked, T.BinaryType())
encoding_of = _bytes_udf(detect_encoding, T.StringType())
gunzip_any = _bytes_udf(lambda data: decode_gzip(data, truncated=True), T.BinaryType())

# --- containers ---------------------------------------------------------------------------------------------------


def to_text(value: Column, kind: T.DataType, encoding: str = "utf-8") -> Column:
    """Bytes as text at any depth of arrays, structs and map values; ``kind`` is the column's type."""
    return _recoded(value, kind, T.BinaryType, lambda x: F.decode(x, encoding))


def to_bytes(value: Column, kind: T.DataType, encoding: str = "utf-8") -> Column:
    """Text as bytes at any depth."""
    return _recoded(value, kind, T.StringType, lambda x: F.encode(x, encoding))


def _recoded(value: Column, kind: T.DataType, leaf: type, change) -> Column:
    if isinstance(kind, leaf):
        return change(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _recoded(x, kind.elementType, leaf, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _recoded(x, kind.valueType, leaf, change))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_recoded(value[f.name], f.dataType, leaf, change).alias(f.name) for f in kind.fields]))
    return value


def json_metadata(**values: Column) -> Column:
    """A JSON object of columns, keys in order, nulls left out."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))
