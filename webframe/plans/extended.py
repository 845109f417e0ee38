"""Queries of crawls with robots, redirects and quota, of look-ups and files, of scrapers, records and containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import text as X
from webframe.functions import urls as U
from webframe.operators import archive as A
from webframe.operators import crawl as CR
from webframe.operators import filters as P
from webframe.operators import frontier as fr
from webframe.operators import hooks as H
from webframe.operators import scrapers as S
from webframe.operators import writers as W
from webframe.plans.catalog import query
from webframe.plans.inputs import CANONICAL_SQL, FRONTIER_SQL, GRAPH_SQL, frontier, graph, page_key, pages
from webframe.session import table


def _crawled(spark, d, config, start, fetched=None, **options):
    edges = graph(spark, d).filter(~F.col("inline"))
    links = edges.select(page_key(F.col("src")).alias("url"), F.col("dst").alias("seq"), page_key(F.col("dst")).alias("link"), "inline", F.lit(None).cast("string").alias("link_type"))
    if fetched is None:
        fetched = pages(spark, d).select(page_key(F.col("page_id")).alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"), F.lit(100).cast("long").alias("size"), F.lit(None).cast("string").alias("location"))
    seeds = spark.range(start, start + 1).select(F.col("id").alias("seq"), page_key(F.col("id")).alias("url"))
    return CR.run(spark, seeds, links, fetched, config, **options)


@query(
    f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 2::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = node WHERE level < 4 AND NOT inline AND (NOT CAST(node AS VARCHAR) LIKE '1%' OR CAST(node AS VARCHAR) LIKE '13%')) "
    "SELECT 'http://site.example/' || node AS url, CAST(min(level) AS INTEGER) AS level, CASE WHEN CAST(node AS VARCHAR) LIKE '1%' AND NOT CAST(node AS VARCHAR) LIKE '13%' THEN 'skipped' ELSE 'done' END AS status FROM w GROUP BY node"
)
def crawl_robots(spark, d):
    """What robots.txt disallows is skipped, and its links aren't followed."""
    files = spark.createDataFrame([("http://site.example", "User-agent: *\nDisallow: /1\nAllow: /13\n")], "origin string, body string")
    return _crawled(spark, d, CrawlConfig(recursive=True, level=4), 2, robots_files=files).frontier.select("url", "level", "status")


_FINAL = "CASE WHEN node % 4 = 0 AND node > 0 THEN node // ((node & -node) // 2) ELSE node END"


@query(
    f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 3::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = {_FINAL} WHERE level < 4 AND NOT inline) "
    "SELECT 'http://site.example/' || node AS url, CAST(min(level) AS INTEGER) AS level, 'done' AS status, CAST(200 AS INTEGER) AS status_code FROM w GROUP BY node"
)
def crawl_redirects(spark, d):
    """Every fourth page redirects to half its number, some of them on and on; an item's links are those of its last page."""
    n = F.col("page_id")
    moved = (n % 4 == 0) & (n > 0)
    fetched = pages(spark, d).select(page_key(n).alias("url"), F.when(moved, 302).otherwise(200).alias("status_code"), F.lit(None).cast("string").alias("error"), F.when(moved, page_key(F.floor(n / 2))).alias("location"))
    return _crawled(spark, d, CrawlConfig(recursive=True, level=4), 3, fetched).frontier.select("url", "level", "status", "status_code")


@query(
    f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = node WHERE level < 6 AND NOT inline), "
    "first AS (SELECT node, min(level) AS level FROM w GROUP BY node), sums AS (SELECT level, sum(count(*)) OVER (ORDER BY level) * 100 AS size FROM first GROUP BY level), "
    "stop AS (SELECT coalesce(min(level), 99) AS level FROM sums WHERE size >= 1000) "
    "SELECT 'http://site.example/' || node AS url, CAST(f.level AS INTEGER) AS level, CASE WHEN f.level <= s.level THEN 'done' ELSE 'todo' END AS status FROM first f, stop s WHERE f.level <= s.level + 1"
)
def crawl_quota(spark, d):
    """No wave begins once the documents have the quota's bytes."""
    return _crawled(spark, d, CrawlConfig(recursive=True, level=6, quota=1000), 1).frontier.select("url", "level", "status")


@query(
    f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = node WHERE level < 3 AND NOT inline AND node % 5 <> 3 AND node % 7 <> 4) "
    "SELECT 'http://site.example/' || node AS url, CASE WHEN node % 5 = 3 THEN 'skipped' WHEN node % 7 = 4 THEN 'skipped' ELSE 'done' END AS status, CAST(CASE WHEN node % 5 <> 3 AND node % 7 = 4 THEN 2 ELSE 1 + CAST(node % 5 <> 3 AND node % 7 = 4 AS INTEGER) END AS INTEGER) AS try_count FROM (SELECT DISTINCT node FROM w)"
)
def crawl_hooks(spark, d):
    """accept_url turns pages away; handle_response has others tried again, until their tries are spent; each hook is told."""
    hooks, told = H.Hooks(), []
    number = lambda url: F.regexp_extract(url, "([0-9]+)$", 1).cast("long")
    hooks.connect("accept_url", lambda url, verdict, reason, results: verdict & (number(url) % 5 != 3))
    hooks.connect("handle_response", lambda url, code: F.when(number(url) % 7 == 4, "retry").otherwise("normal"))
    hooks.connect("queued_url", lambda rows: told.append("queued"))
    hooks.connect("dequeued_url", lambda rows: told.append("dequeued"))
    hooks.connect("finishing_statistics", lambda s: told.append(s["files"]))
    hooks.connect("exit_status", lambda code: 42)
    done = _crawled(spark, d, CrawlConfig(recursive=True, level=3, tries=1), 1, hooks=hooks)
    if done.exit_code != 42 or told[-1] != done.files or told.count("queued") != told.count("dequeued") + 1:
        raise RuntimeError(f"hooks weren't told: {told}")
    return done.frontier.select("url", "status", "try_count")


@query(f"SELECT page_id, {CANONICAL_SQL} AS url FROM pages WHERE {CANONICAL_SQL} = (SELECT min({CANONICAL_SQL}) FROM pages)")
def frontier_point_lookup(spark, d):
    rows = pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("url"))
    return fr.get_one(rows, rows.agg(F.min("url")).first()[0])


@query(f"SELECT page_id, page_id % 3 = 0 AND EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 4 = 0 AND regexp_extract(q.url, '^([^#]*)', 1) = regexp_extract(p.url, '^([^#]*)', 1)) AS known FROM pages p")
def frontier_contains(spark, d):
    rows = pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("url"))
    asked = rows.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#no"))))
    known = rows.filter(F.col("page_id") % 4 == 0).select("url").distinct()
    return fr.contains(known, asked).select("page_id", "known")


@query(f"WITH {FRONTIER_SQL} SELECT seq, url, root_url, (SELECT count(DISTINCT u) FROM (SELECT url AS u FROM frontier UNION ALL SELECT root_url FROM frontier)) AS n_strings FROM frontier")
def frontier_interning(spark, d):
    """Strings are replaced by ids and come back."""
    rows = frontier(spark, d).select("seq", "url", "root_url")
    strings, ids = fr.interned(rows, ("url", "root_url"))
    back = fr.restored(strings, ids, ("url", "root_url"))
    return back.crossJoin(strings.agg(F.count("*").alias("n_strings")))  # one row


@query(f"WITH {FRONTIER_SQL} SELECT url, filename, CASE WHEN seq % 3 = 0 THEN 'done' ELSE 'in_progress' END AS file_status FROM frontier WHERE status = 'done'")
def frontier_files(spark, d):
    """Files of finished URLs are checked out with their records, and some of them in."""
    files, out = fr.file_check_out(fr.queued_files(frontier(spark, d)), frontier(spark, d))
    return fr.file_check_in(files, out.filter(F.col("seq") % 3 == 0).select("url", F.lit("done").alias("new_status")))


@query(f"WITH {FRONTIER_SQL} SELECT max(seq) AS last_seq FROM frontier")
def frontier_last_seq(spark, d):
    return fr.last_seq(frontier(spark, d))


@query("SELECT count(*) AS n, true AS whole FROM documents")
def insert_batches(spark, d):
    """Batches of at most 100 rows hold every row once."""
    batches = fr.numbered_batches(table(spark, d, "documents").select("doc_id"), 100, F.col("doc_id")).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("m"))
    return batches.agg(F.sum("n").alias("n"), ((F.max("n") <= 100) & (F.sum("n") == F.sum("m"))).alias("whole"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def cache_eviction(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct("ts", "event_id").alias("used_at"))
    return fr.evicted(rows, 50).select("event_id")


@query("SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) < 86400000000::BIGINT * 3 ORDER BY ts DESC, event_id DESC LIMIT 400")
def cache_ttl(spark, d):
    """A cache of 400 items at most, none of them three days old."""
    rows = table(spark, d, "events").select("event_id", "ts")
    now = rows.agg(F.max("ts")).first()[0]
    return fr.kept(rows, F.lit(now), 400, 3 * 86400, "ts", F.desc("event_id")).select("event_id")


@query("WITH p AS (SELECT page_id, url, html FROM pages), r AS (SELECT page_id, 'GET ' || url || ' HTTP/1.1' || chr(13) || chr(10) || chr(13) || chr(10) AS ask, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || chr(13) || chr(10) AS head, html FROM p) SELECT page_id, 'request' AS record_type, CAST(octet_length(encode(ask)) AS INTEGER) AS size, sha1(ask) AS digest, false AS linked FROM r UNION ALL SELECT page_id, 'response', CAST(octet_length(encode(head || html)) AS INTEGER), sha1(html), true FROM r")
def warc_exchange(spark, d):
    """Requests and responses as pairs of records; the digest of a response is its payload's."""
    ask = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    rows = pages(spark, d).select(F.col("page_id").alias("key"), "url", ask.alias("request_head"), F.lit("HTTP/1.1 200 OK\r\n\r\n").alias("response_head"), F.col("html").alias("body"))
    records = A.exchange_records(rows)
    requests = records.filter("record_type = 'request'").select(F.col("id").alias("asked"))
    payload = F.expr("substring(block, coalesce(payload_offset, 0) + 1)")
    met = records.join(requests, records["concurrent_to"] == requests["asked"], "left")
    return met.select(F.col("key").alias("page_id"), "record_type", F.octet_length("block").alias("size"), F.sha1(payload).alias("digest"), F.col("asked").isNotNull().alias("linked"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2001-02-03 04:05:06' ELSE date_trunc('second', ts) END AS modified FROM events")
def last_modified_stamp(spark, d):
    header = F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "not a date").otherwise(header).alias("last_modified"), F.lit("2001-02-03 04:05:06").cast("timestamp").alias("fetched_at"))
    return W.stamped(rows).select("event_id", F.col("modified").cast("timestamp_ntz").alias("modified"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'ftp' ELSE 'skipped' END AS outcome FROM pages")
def scheme_dispatch(spark, d):
    schemes = F.array(*[F.lit(x) for x in ("http", "ftp", "gopher", "mailto")])
    rows = pages(spark, d).select("page_id", F.get(schemes, F.col("page_id") % 4).alias("scheme"))
    return P.by_scheme(rows, {n: lambda df, n=n: df.withColumn("outcome", F.lit(n)) for n in ("http", "ftp")}).select("page_id", "outcome")


@query("SELECT page_id, url LIKE '%.html%' OR url LIKE '%/en/%' OR url LIKE '%?%' AS web, url LIKE '%.html%' AND url LIKE '%/en/%' AS generic FROM pages")
def request_predicates(spark, d):
    """Virtual items (here: with a query) always pass; a redirect (of a file) passes if hosts alone are against it."""
    html, english, asked = (F.col("url").contains(x) for x in (".html", "/en/", "?"))
    web = P.subsequent_request({"SpanHostsFilter": english}, html, asked)
    generic = P.generic_request({"RegexFilter": html, "SpanHostsFilter": english})
    return pages(spark, d).select("page_id", web.alias("web"), generic.alias("generic"))


@query("SELECT true AS near, true AS again")
def random_drop(spark, d):
    """A share of 0.75 of the documents, the same ones each time."""
    docs = table(spark, d, "documents").select("doc_id")
    kept = P.sampled(docs, 0.75, 5, "doc_id").agg(F.count("*").alias("kept"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark"))
    again = P.sampled(docs.repartition(3), 0.75, 5, "doc_id").agg(F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark2"))
    every = docs.agg(F.count("*").alias("n"))
    both = kept.crossJoin(again).crossJoin(every)  # one row each
    return both.select((F.abs(F.col("kept") / F.col("n") - 0.75) < 0.1).alias("near"), (F.col("mark") == F.col("mark2")).alias("again"))


@query(
    "SELECT page_id, s AS scraper, CASE s WHEN 'html' THEN 'http://h.example/p' || page_id WHEN 'css' THEN 'http://h.example/d/i' || page_id || '.png' WHEN 'javascript' THEN 'http://j.example/' || page_id || '.js' ELSE 'http://m.example/' || page_id END AS link "
    "FROM pages, (SELECT unnest(['html', 'css', 'javascript', 'sitemap']) AS s) WHERE s = (['html', 'css', 'javascript', 'sitemap'])[page_id % 4 + 1] AND page_id % 5 <> 0"
)
def scraper_demux(spark, d):
    """Documents of four types, of which a fifth is expected to be something else, go to the scrapers that are for them."""
    n = F.col("page_id")
    t = n.cast("string")
    kinds = ("html", "css", "javascript", "sitemap")
    bodies = (
        F.concat(F.lit("<html><a href=/p"), t, F.lit(">x</a></html>")), F.concat(F.lit("a{background:url(i"), t, F.lit(".png)}")),
        F.concat(F.lit('load("http://j.example/'), t, F.lit('.js")')), F.concat(F.lit('<?xml version="1.0"?><urlset><url><loc>http://m.example/'), t, F.lit("</loc></url></urlset>")),
    )
    media = F.array(*[F.lit(x) for x in ("text/html", "text/css", "application/javascript", "application/xml")])
    url = F.concat(F.lit("http://h.example/d/"), t)
    docs = pages(spark, d).select("page_id", url.alias("url"), F.get(media, n % 4).alias("content_type"), F.get(F.array(*bodies), n % 4).alias("body"), F.when(n % 5 == 0, "media").when(n % 2 == 0, F.get(F.array(*[F.lit(k) for k in kinds]), n % 4)).alias("link_type"))
    found = S.scrape(docs, S.assemble(CrawlConfig(sitemaps=True)), first_only=True)
    return found.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "scraper", "link")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n_links, text AS whole FROM documents")
def text_segments(spark, d):
    """Segments cover the text; the matched ones are counted."""
    s = S.segments(F.col("text"), "[A-Z][a-z]+")
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(s, lambda x: x["is_link"])).cast("long").alias("n_links"), F.array_join(F.transform(s, lambda x: x["text"]), "").alias("whole"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ' ') AS words FROM documents")
def chunked_scan(spark, d):
    """Matches found in overlapping chunks of 1,000 characters are those of the whole text."""
    return table(spark, d, "documents").select("doc_id", F.array_join(S.scanned(F.col("text"), "[A-Z][a-z]+", 1_000, 200), " ").alias("words"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z]+(?: [a-z]+)?'), '|') AS words FROM documents")
def chunked_scan_anywhere(spark, d):
    """The same for a pattern that could begin again inside of each match, in chunks of 300 characters."""
    return table(spark, d, "documents").select("doc_id", F.array_join(S.scanned(F.col("text"), "[a-zA-Z]+(?: [a-z]+)?", 300, 200), "|").alias("words"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def partial_append(spark, d):
    """Texts that come in four partial responses behind what is there, with errors between them, are whole again."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    step = F.floor(F.octet_length(body) / 5).cast("int") + 1
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), body.alias("all"), step.alias("step"))
    held = rows.select("doc_id", "path", F.substring("all", F.lit(1), F.col("step")).alias("body"))
    part = F.explode(F.transform(F.array(*[F.lit(k) for k in (4, 2, 1, 3)]), lambda k: F.struct(k.alias("seq"), F.substring(F.col("all"), k * F.col("step") + 1, F.col("step")).alias("body"))))
    parts = rows.select("path", part.alias("x")).select("path", "x.seq", F.lit(206).alias("code"), "x.body")
    errors = rows.select("path", F.lit(2).alias("seq"), F.lit(416).alias("code"), F.lit(b"Range Not Satisfiable").alias("body"))
    return W.appended(held, parts.unionByName(errors), F.col("seq")).select("doc_id", F.sha2("body", 256).alias("digest"))


@query("SELECT page_id, url, '{\"n\":' || page_id || ',\"url\":' || CAST(to_json(url) AS VARCHAR) || '}' AS meta FROM pages")
def containers_and_metadata(spark, d):
    rows = pages(spark, d).select("page_id", F.struct(F.array(F.encode("url", "utf-8")).alias("list"), F.create_map(F.lit("k"), F.encode("url", "utf-8")).alias("map")).alias("held"), "url")
    text = X.to_text(F.col("held"), rows.schema["held"].dataType)
    back = X.to_bytes(text, rows.select(text.alias("t")).schema["t"].dataType)
    same = F.when(back["list"] == F.col("held.list"), F.when(text["map"]["k"] == text["list"][0], text["list"][0]))
    return rows.select("page_id", same.alias("url"), X.json_metadata(url=F.col("url"), n=F.col("page_id"), none=F.lit(None).cast("string")).alias("meta"))


@query("SELECT doc_id, replace(text, ' ', '+') AS text, text AS plus FROM documents")
def url_percent_decode(spark, d):
    """Whole texts that were escaped come back; a plus sign stands for a space in one of the two forms."""
    encoded = F.url_encode("text")
    return table(spark, d, "documents").select("doc_id", U.str_udf(U.percent_decode)(encoded).alias("text"), U.str_udf(U.percent_decode_plus)(encoded).alias("plus"))
