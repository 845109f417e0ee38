"""Queries of URL, text, name and header functions."""

from __future__ import annotations

import datetime as dt
import gzip
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from webframe.functions import links as L
from webframe.functions import naming as N
from webframe.functions import text as X
from webframe.functions import urls as U
from webframe.operators import cookies, ftp
from webframe.plans.catalog import query
from webframe.plans.inputs import LINKS_SQL, anchor_links, pages
from webframe.session import table

_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_PATH = "CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) END"


@query(f"SELECT page_id, lower(regexp_extract(url, '^([^:]+):', 1)) AS scheme, {_HOST} AS hostname, CAST(CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS INTEGER) AS port, {_PATH} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", U.scheme(u).alias("scheme"), U.hostname(u).alias("hostname"), U.port(u).alias("port"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))


@query(f"SELECT page_id, regexp_extract(url, '^([^#]*)', 1) AS url, {_HOST} AS hostname, CAST(CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS INTEGER) AS port, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def url_info_full(spark, d):
    return U.with_url_info(pages(spark, d).select("page_id", "url")).select("page_id", "info.url", "info.hostname", "info.port", "info.query")


@query("SELECT page_id, regexp_extract(url, '^([^#]*)', 1) AS url FROM pages")
def url_canonical(spark, d):
    return pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("url"))


@query(f"SELECT page_id, {_HOST} AS plain, {_HOST} || ':8080' AS given FROM pages")
def url_hostname_with_port(spark, d):
    other = F.regexp_replace("url", "^([^:]+://[^/?#]*)", "$1:8080")
    return pages(spark, d).select("page_id", U.hostname_with_port(F.col("url")).alias("plain"), U.hostname_with_port(other).alias("given"))


@query(f"SELECT page_id, regexp_extract({_PATH}, '^(.*)/', 1) AS dirname, regexp_extract({_PATH}, '([^/]*)$', 1) AS basename FROM pages")
def url_split_path(spark, d):
    return pages(spark, d).select("page_id", U.split_path(U.path(F.col("url"))).alias("p")).select("page_id", "p.*")


@query(f"SELECT page_id, CASE WHEN url LIKE '%/' THEN array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''), '/') ELSE array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[1:-2], '/') END AS dirs FROM pages")
def url_dir_parts(spark, d):
    return pages(spark, d).select("page_id", F.array_join(N.dir_parts(F.col("url")), "/").alias("dirs"))


@query("SELECT page_id, regexp_extract(p, '^([^=]*)', 1) AS name, regexp_extract(p, '=(.*)$', 1) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> '' AND p LIKE '%=_%'")
def url_query_pairs(spark, d):
    return pages(spark, d).select("page_id", F.explode(U.split_query(U.query(F.col("url")))).alias("p")).select("page_id", "p.*")


_QUERIES = "regexp_extract(url, '\\?([^#]*)', 1) || '&k' || page_id % 3 || '=a+b&k0=c=d&&k' || page_id % 2"


@query(
    f"WITH p AS (SELECT page_id, string_split({_QUERIES}, '&') AS ps FROM pages), x AS (SELECT page_id, i, ps[i] AS p FROM (SELECT page_id, ps, unnest(generate_series(1, len(ps))) AS i FROM p)), "
    "v AS (SELECT page_id, regexp_extract(p, '^([^=]*)', 1) AS name, min(i) AS first, string_agg(replace(regexp_extract(p, '=(.*)$', 1), '+', ' '), ',' ORDER BY i) AS held FROM x GROUP BY 1, 2) "
    "SELECT page_id, string_agg(name || '=' || held, ';' ORDER BY first) AS flat FROM v GROUP BY page_id"
)
def url_query_map(spark, d):
    n = F.col("page_id")
    text = F.concat(U.query(F.col("url")), F.lit("&k"), (n % 3).cast("string"), F.lit("=a+b&k0=c=d&&k"), (n % 2).cast("string"))
    m = U.query_map(text)
    return pages(spark, d).select("page_id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("flat"))


@query(f"SELECT page_id, CASE WHEN ({_PATH}) LIKE '%/' THEN ({_PATH}) || 'b/' ELSE regexp_extract({_PATH}, '^(.*/)', 1) || 'b/' END AS path FROM pages")
def url_flatten_path(spark, d):
    f = U.str_udf(lambda p: U.flatten_path(p + "/../a/./..//b//", True) if not p.endswith("/") else U.flatten_path(p + "x/../a/./..//b//", True))
    return pages(spark, d).select("page_id", f(U.path(F.col("url"))).alias("path"))


@query("SELECT doc_id, replace(replace(url_encode(regexp_replace(text, '[^a-zA-Zà-ÿ ]', '', 'g')), '+', '%20'), '%20', '%20') AS encoded FROM documents")
def url_percent_encode(spark, d):
    f = U.str_udf(U.percent_encode)
    return table(spark, d, "documents").select("doc_id", f(F.regexp_replace("text", "[^a-zA-Zà-ÿ ]", "")).alias("encoded"))


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM links")
def url_join_links(spark, d):
    return anchor_links(spark, d).select("page_id", F.col("pos").cast("long"), "link")


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, link FROM links")
def url_join_full(spark, d):
    return anchor_links(spark, d).select("page_id", F.col("pos").cast("long"), U.canonical(U.urljoin("url", "href")).alias("link"))


@query("SELECT page_id, q || '&a=1' AS stripped FROM (SELECT page_id, CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN 'z=0' ELSE regexp_extract(url, '\\?([^#]*)', 1) END AS q FROM pages)")
def url_strip_session(spark, d):
    q = F.when(U.query(F.col("url")) == "", "z=0").otherwise(U.query(F.col("url")))
    given = F.concat(q, F.lit("&sid="), F.md5(F.col("url").cast("binary")), F.lit("&a=1"))
    return pages(spark, d).select("page_id", U.strip_query_session(given).alias("stripped"))


@query("SELECT page_id, CASE WHEN url LIKE '%#top' THEN regexp_extract(url, '^([^#]*)', 1) || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || '_escaped_fragment_=top' ELSE url END AS url FROM pages")
def url_escaped_fragment(spark, d):
    return pages(spark, d).select("page_id", U.rewrite(F.regexp_replace("url", "#top$", "#!top"), hash_fragment=True).alias("url"))


_FULL = f"{_PATH.replace('CASE', '(CASE', 1)}) || CASE WHEN ({_PATH}) LIKE '%/' THEN '' ELSE '/' END"


@query(f"SELECT page_id, ({_FULL}) LIKE '/en/%' AS under, regexp_extract({_PATH}, '^(.*/)', 1) LIKE '/fr/%' AS under_slash, regexp_matches({_FULL}, '^/[a-z][a-z]/1') AS glob FROM pages")
def url_is_subdir(spark, d):
    p = U.path(F.col("url"))
    return pages(spark, d).select("page_id", U.is_subdir("/en", p).alias("under"), U.is_subdir("/fr/x", p, trailing_slash=True).alias("under_slash"), U.is_subdir("/??/1*", p, wildcards=True).alias("glob"))


@query(
    f"WITH {LINKS_SQL}, named AS (SELECT page_id, pos, regexp_extract(link || (['.css', '.js', '.html', '.png', '.mp3', '.zip', '', '.com'])[pos % 8 + 1], '^([^?]*)', 1) AS link FROM links) "
    "SELECT page_id, pos, CASE WHEN link LIKE '%.css' THEN 'css' WHEN link LIKE '%.js' THEN 'javascript' WHEN link LIKE '%.html' THEN 'html' WHEN link LIKE '%.png' OR link LIKE '%.mp3' THEN 'media' END AS link_type, link LIKE '%.js' OR link LIKE '%.png' OR link LIKE '%.mp3' AS inline FROM named"
)
def link_type_by_ext(spark, d):
    ends = F.array(*[F.lit(x) for x in (".css", ".js", ".html", ".png", ".mp3", ".zip", "", ".com")])
    rows = anchor_links(spark, d).withColumn("link", F.concat("link", F.get(ends, F.col("pos") % 8)))
    return rows.select("page_id", F.col("pos").cast("long"), L.link_type(F.col("link")).alias("link_type"), L.is_likely_inline(F.col("link")).alias("inline"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), '') AS soup FROM documents")
def link_soup_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_link_soup(F.col("text")).alias("soup"))


@query("SELECT page_id, url AS target FROM pages")
def meta_refresh(spark, d):
    header = F.concat(F.lit("3; URL = '"), F.col("url"), F.lit("'"))
    return pages(spark, d).select("page_id", X.parse_refresh(F.regexp_replace(header, " = ", " =")).alias("target"))


@query("SELECT page_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%.1f MiB', b / 1048576.0) END AS size FROM (SELECT page_id, length(html) * 64 AS b FROM pages)")
def format_size(spark, d):
    return pages(spark, d).select("page_id", X.format_size(F.length("html") * 64).alias("size"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso8601(spark, d):
    t = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", X.iso8601_seconds(X.iso8601(t)).alias("seconds"), X.iso8601(t).alias("iso"))


@query("SELECT event_id, date_trunc('second', ts) AS modified FROM events")
def http_date(spark, d):
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return table(spark, d, "events").select("event_id", X.http_date(text).cast("timestamp_ntz").alias("modified"))


@query(f"SELECT page_id, './' || {_HOST} || CASE WHEN dirs = '' THEN '' ELSE '/' || dirs END || '/' || CASE WHEN name = '' THEN 'index.html' ELSE name END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS path FROM (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS name, CASE WHEN url LIKE '%/' THEN trim(p, '/') ELSE array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '')[1:-2], '/') END AS dirs FROM (SELECT page_id, url, {_PATH} AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages))")
def path_name(spark, d):
    return pages(spark, d).select("page_id", N.file_path(F.col("url"), host=True).alias("path"))


@query("SELECT page_id, CASE WHEN length(n) > 40 THEN substr(n, 1, 32) || substr(sha1(n), 1, 8) ELSE n END AS udf, CASE WHEN length(n) > 40 THEN substr(n, 1, 32) || substr(sha1(n), 1, 8) ELSE n END AS native FROM (SELECT page_id, replace(url, '/', '_') AS n FROM pages)")
def safe_filename_len(spark, d):
    n = F.translate("url", "/", "_")
    return pages(spark, d).select("page_id", N.safe_filename(n, max_length=40).alias("udf"), N.cap_ascii(n, 40).alias("native"))


@query("SELECT page_id, 'file ' || page_id || '.html' AS quoted, 'f' || page_id || '.txt' AS plain FROM pages")
def content_disposition(spark, d):
    n = F.col("page_id").cast("string")
    quoted, plain = F.concat(F.lit('attachment; filename="file '), n, F.lit('.html"; x=1')), F.concat(F.lit("inline; FileName = f"), n, F.lit(".txt ; size=3"))
    return pages(spark, d).select("page_id", N.content_disposition(quoted).alias("quoted"), N.content_disposition(plain).alias("plain"))


@query("SELECT page_id, 'Content-Length' AS name1, CAST(length(html) AS VARCHAR) AS value1, 'X-Long-Url' AS name2, url || ' folded' AS value2, CAST(3 AS INTEGER) AS n FROM pages")
def header_parse(spark, d):
    head = F.concat(F.lit("content-length:"), F.length("html").cast("string"), F.lit("\r\nx-long-URL: "), F.col("url"), F.lit("\r\n\tfolded\r\nno colon\r\nVia :  a: b \r\n"))
    f = X.header_fields(head)
    g = lambda i, c: F.get(f, F.lit(i))[c]
    return pages(spark, d).select("page_id", g(0, "name").alias("name1"), g(0, "value").alias("value1"), g(1, "name").alias("name2"), g(1, "value").alias("value2"), F.size(f).alias("n"))


@query("SELECT page_id, 'Content-Type: text/html' || chr(13) || chr(10) || 'X-Url: ' || url || chr(13) || chr(10) AS head, true AS crlf FROM pages")
def header_serialize(spark, d):
    head = F.concat(F.lit("content-type: text/html\r\nx-url:"), F.col("url"), F.lit("\r\n"))
    return pages(spark, d).select("page_id", X.header_text(X.header_fields(head)).alias("head"), (X.line_ending(head) == "\r\n").alias("crlf"))


@query("SELECT page_id, 'HTTP/1.1' AS version, CAST(200 + page_id % 300 AS INTEGER) AS code, 'Reason ' || page_id AS reason, 'GET' AS method, 'http://h.example/p' || page_id AS url FROM pages")
def http_heads(spark, d):
    n = F.col("page_id").cast("string")
    answer = X.response_line(F.concat(F.lit("HTTP/1.1  "), (F.col("page_id") % 300 + 200).cast("string"), F.lit(" Reason "), n, F.lit("\r\nA: b\r\n")))
    ask = X.request_line(F.concat(F.lit("GET /p"), n, F.lit(" HTTP/1.1\r\nHost: h.example\r\n\r\n")))
    return pages(spark, d).select("page_id", answer.alias("a"), ask.alias("r")).select("page_id", "a.version", "a.code", "a.reason", "r.method", "r.url")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'chunked' WHEN 1 THEN 'length' ELSE 'close' END AS strategy, page_id % 2 = 0 AS closes, page_id % 3 = 2 AND page_id % 5 = 0 AS no_body, 'utf-8' AS charset, CASE WHEN page_id % 2 = 0 THEN 'application/xhtml' ELSE '-' END AS mime FROM pages")
def http_framing(spark, d):
    n = F.col("page_id")
    te, cl = F.when(n % 3 == 0, "gzip, chunked"), F.when(n % 3 == 1, "12")
    kind = F.when(n % 2 == 0, "application/xhtml+xml; Charset='UTF-8'").otherwise("; charset=utf-8")
    return pages(spark, d).select(
        "page_id", X.read_strategy(te, cl).alias("strategy"), X.should_close(F.lit("HTTP/1.1"), F.when(n % 2 == 0, "Close")).alias("closes"),
        X.has_no_body(F.lit("GET"), F.when(n % 5 == 0, 304).otherwise(200), te, cl).alias("no_body"), X.charset(kind).alias("charset"), X.mimetype(kind).alias("mime"),
    )


_zipped = X._bytes_udf(gzip.compress, T.BinaryType())
_deflated = X._bytes_udf(lambda b: zlib.compress(b)[2:-4], T.BinaryType())


@query("SELECT page_id, CAST(octet_length(encode(html)) AS INTEGER) AS size, sha1(html) AS digest, sha1(html) AS inflated, page_id % 4 = 3 AS cut FROM pages")
def body_decoding(spark, d):
    """Chunked pages, a half of them gzip inside, are put together and inflated again; a cut transfer gives null."""
    body = F.encode("html", "utf-8")
    sent = F.when(F.col("page_id") % 2 == 0, _zipped(body)).otherwise(body)
    rows = pages(spark, d).select("page_id", sent.alias("sent"), _deflated(body).alias("raw"))
    head = F.concat(F.lower(F.hex(F.octet_length("sent").cast("long"))), F.lit(";x=1\r\n")).cast("binary")
    chunked = F.concat(head, "sent", F.lit("\r\n0\r\n\r\n").cast("binary"))
    whole, part = X.gunzip(X.unchunk(chunked)), X.unchunk(F.when(F.col("page_id") % 4 == 3, F.substring(chunked, 1, 9)).otherwise(chunked))
    return rows.select("page_id", F.octet_length(whole).alias("size"), F.sha1(whole).alias("digest"), F.sha1(X.inflate("raw")).alias("inflated"), part.isNull().alias("cut"))


@query()
def charset_detection(spark, d):
    data = F.when(F.col("page_id") % 2 == 0, F.encode("html", "utf-8")).otherwise(F.encode(F.regexp_replace("html", "[^\\x00-\\xFF]", ""), "iso-8859-1"))
    return pages(spark, d).select("page_id", X.encoding_of(data).alias("encoding"))


_SNIFFED = (
    # media type, body, path; html, css, javascript, xml, sitemap
    ("text/html", "var x", "/a", True, False, True, False, False),
    ("text/html", "<HTML> color: var", "/a.css", True, False, False, False, False),
    ("text/plain", "color: red; var x", "/a", False, False, False, False, False),
    ("text/plain", "x", "/a.CSS", False, True, False, False, False),
    ("text/css", "<html>", "/a", True, True, False, False, False),
    (None, "@import x", "/a", False, True, False, False, False),
    (None, "setTimeout(1)", "/a.xhtml", True, False, True, False, False),
    ("application/javascript", "x", "/s.js", False, False, True, False, False),
    ("application/rss+xml", "x", "/a", False, False, False, True, False),
    ("x/y", "<?xml version='1'?><urlset>", "/a", False, False, False, True, True),
    ("x/y", "<?xml version='1'?><URLSET>", "/a", False, False, False, True, False),
    ("x/y", "x", "/robots.txt", False, False, False, False, True),
    ("x/y", "<body><!-- x -->", "/sitemap-1.xml", False, False, False, True, True),
    ("x/y", "<a\x01 href=x>", "/a", True, False, False, False, False),
)
_SNIFFED_SQL = ", ".join(f"({i}, {', '.join(map(str, row[3:]))})" for i, row in enumerate(_SNIFFED))


@query(f"SELECT page_id, t.html, t.css, t.js, t.xml, t.sitemap FROM pages JOIN (VALUES {_SNIFFED_SQL}) AS t(i, html, css, js, xml, sitemap) ON page_id % {len(_SNIFFED)} = i")
def doc_sniff(spark, d):
    """Fourteen kinds of responses; bodies go on with those of the pages far beyond what is looked at."""
    case = F.get(F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip("kbp", row[:3], strict=True)]) for row in _SNIFFED]), F.col("page_id") % len(_SNIFFED))
    kind, body, p = case["k"], F.concat(case["b"], F.lit(" " * 4096), F.col("html")), case["p"]
    return pages(spark, d).select("page_id", X.is_html(kind, body, p).alias("html"), X.is_css(kind, body, p).alias("css"), X.is_javascript(kind, body, p).alias("js"), X.is_xml(kind, body, p).alias("xml"), X.is_sitemap(body, p).alias("sitemap"))


_LISTING_NOW = dt.datetime(2024, 6, 1)


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS listing, 'part ' || p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN 'dir' ELSE 'file' END AS type, CAST(p_size AS BIGINT) AS size, TIMESTAMP '2023-02-01' + to_days(CAST(p_partkey % 28 AS INTEGER)) AS date, CAST(CASE WHEN p_partkey % 10 = 0 THEN 493 ELSE 420 END AS INTEGER) AS perm FROM part")
def ftp_listing_unix(spark, d):
    n = F.col("p_partkey")
    line = F.concat(F.when(n % 10 == 0, "drwxr-xr-x").otherwise("-rw-r--r--"), F.lit(" 1 ftp  ftp "), F.lpad(F.col("p_size").cast("string"), 8, " "), F.lit(" Feb "), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 2023 part "), n.cast("string"))
    files = table(spark, d, "part").groupBy(F.floor(n / 50).cast("long").alias("listing")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return ftp.listings(files, "listing", "text", _LISTING_NOW).select("listing", "name", "type", "size", F.col("date").cast("timestamp_ntz").alias("date"), "perm")


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS listing, 'part ' || p_partkey AS name, CASE WHEN p_partkey % 10 = 0 THEN 'dir' ELSE 'file' END AS type, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS BIGINT) END AS size, TIMESTAMP '2023-02-13 13:05:00' + to_days(CAST(p_partkey % 15 AS INTEGER)) AS date FROM part")
def ftp_listing_msdos(spark, d):
    n = F.col("p_partkey")
    line = F.concat(F.lit("02-"), (n % 15 + 13).cast("string"), F.lit("-23  01:05PM   "), F.when(n % 10 == 0, "   <DIR>     ").otherwise(F.lpad(F.col("p_size").cast("string"), 12, " ")), F.lit(" part "), n.cast("string"))
    files = table(spark, d, "part").groupBy(F.floor(n / 50).cast("long").alias("listing")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\r\n").alias("text"))
    return ftp.listings(files, "listing", "text", _LISTING_NOW).select("listing", "name", "type", "size", F.col("date").cast("timestamp_ntz").alias("date"))


@query("SELECT p_partkey, CAST((p_partkey % 8) * 64 + (p_partkey % 4) * 8 + p_partkey % 2 AS INTEGER) AS perm FROM part")
def ftp_perm(spark, d):
    n = F.col("p_partkey")
    bit = lambda m, k, c: F.when(F.floor((n % m) / k) % 2 == 1, c).otherwise("-")
    text = F.concat(bit(8, 4, "r"), bit(8, 2, "w"), bit(8, 1, "x"), F.lit("-"), bit(4, 2, "w"), bit(4, 1, "s"), F.lit("--"), bit(2, 1, "x"))
    return table(spark, d, "part").select("p_partkey", ftp.perm_bits(text).alias("perm"))


@query("SELECT o_orderkey, 'order ' || o_orderkey AS name, 'file' AS type, o_orderkey * 3 AS size, date_trunc('second', o_orderdate) AS date FROM orders")
def mlsd_parse(spark, d):
    line = F.concat(F.lit("Type=file;Size="), (F.col("o_orderkey") * 3).cast("string"), F.lit(";Modify="), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("; order "), F.col("o_orderkey").cast("string"))
    rows = ftp.machine_listing(table(spark, d, "orders").select("o_orderkey", line.alias("line")))
    return rows.select("o_orderkey", "name", "type", "size", F.col("date").cast("timestamp_ntz").alias("date"))


@query("SELECT c_custkey, CAST(227 AS INTEGER) AS code, '10.0.0.' || (c_custkey % 256) AS host, CAST((c_custkey % 200) * 256 + 7 AS INTEGER) AS port, 'RETR' AS command, 'file ' || c_custkey AS argument FROM customer")
def ftp_replies(spark, d):
    n = F.col("c_custkey")
    text = F.concat(F.lit("227-Hello\r\n227 Entering (10,0,0,"), (n % 256).cast("string"), F.lit(","), (n % 200).cast("string"), F.lit(",7)\r\n"))
    r, a, c = ftp.reply(text), ftp.passive_address(text), ftp.command(F.concat(F.lit("retr file "), n.cast("string"), F.lit("\r\n")))
    return table(spark, d, "customer").select("c_custkey", r["code"].alias("code"), a["host"].alias("host"), a["port"].alias("port"), c["name"].alias("command"), c["argument"].alias("argument"))


@query("SELECT '.h' || (c_custkey % 40) AS domain, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 2000000000 + c_custkey END AS expires, 'n' || c_custkey AS name, c_mktsegment AS value FROM customer")
def cookie_file(spark, d):
    n = F.col("c_custkey")
    line = F.concat_ws("\t", F.concat(F.lit(".h"), (n % 40).cast("string")), F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.when(n % 7 == 0, "0").otherwise((n + 2000000000).cast("string")), F.concat(F.lit("n"), n.cast("string")), F.col("c_mktsegment"))
    return cookies.parse(table(spark, d, "customer").select(line.alias("value"))).select("domain", "expires", "name", "value")


@query("SELECT 'h' || (c_custkey % 5) AS domain, c_custkey, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) <= 50 AS ok FROM customer")
def cookie_limits(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("h"), (F.col("c_custkey") % 5).cast("string")).alias("domain"), "c_custkey", F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("value"))
    return cookies.accepted(rows, F.col("c_custkey")).select("domain", "c_custkey", "ok")
