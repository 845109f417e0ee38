"""Queries of link extraction, the frontier and crawling over the snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import urls as U
from webframe.operators import crawl as CR
from webframe.operators import extract as E
from webframe.operators import frontier as fr
from webframe.plans.catalog import query
from webframe.plans.inputs import CANONICAL_SQL, FRONTIER_SQL, GRAPH_SQL, LINKS_SQL, anchor_links, frontier, graph, linked_pages, page_key, pages

_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"


@query(f"WITH {LINKS_SQL} SELECT {_HOST} AS host, count(*) AS n_links, count(DISTINCT link) AS n_targets FROM links GROUP BY 1")
def links_by_host(spark, d):
    rows = anchor_links(spark, d).select(U.hostname(F.col("url")).alias("host"), "link")
    each = rows.groupBy("host", "link").agg(F.count("*").alias("n"))  # counts of a hot host are spread over its links first
    return each.groupBy("host").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_targets"))


@query(f"WITH {LINKS_SQL} SELECT DISTINCT page_id, link FROM links")
def links_html(spark, d):
    found = E.html_links(linked_pages(spark, d))
    hrefs = found.filter((F.col("tag") == "a") & (F.col("attrib") == "href"))
    return hrefs.select("page_id", U.canonical(F.col("link")).alias("link")).distinct()


@query(
    "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) || 'a{background:url(img/' || page_id || '.png)}' AS css FROM pages) "
    "SELECT page_id, 'img/' || page_id || '.png' AS link, 'media' AS link_type FROM t"
)
def links_css(spark, d):
    css = F.explode(E.style_texts(F.col("html"))).alias("css")
    image = F.concat(F.lit("a{background:url(img/"), F.col("page_id").cast("string"), F.lit(".png)}"))
    rows = pages(spark, d).select("page_id", css).select("page_id", F.explode(E.css_urls(F.concat("css", image))).alias("l"))
    return rows.select("page_id", "l.link", "l.link_type")


@query()
def links_js(spark, d):
    text = F.concat(F.lit('f("http:\\/\\/a.example\\/'), F.col("page_id").cast("string"), F.lit('\\/x.html");'), "s")
    rows = pages(spark, d).select("page_id", F.explode(E.script_texts(F.col("html"))).alias("s"))
    return rows.select("page_id", F.explode(E.script_strings(text)).alias("link"))


@query("SELECT page_id, page_id % 3 + page_id % 2 + 1 AS n_inline, page_id % 4 + page_id % 2 + 1 AS n_linked FROM pages")
def links_inline_linked_counts(spark, d):
    """Images, a frame, which is both, a style sheet and a next page besides anchors."""
    from webframe.operators.stats import link_counts

    n = F.col("page_id")
    some = lambda most, text: F.array_join(F.transform(F.filter(F.array(*[F.lit(i) for i in range(1, 4)]), lambda i: i <= n % most), text), "")
    html = F.concat(
        some(3, lambda i: F.concat(F.lit("<img src=i"), i, F.lit(".png>"))), some(4, lambda i: F.concat(F.lit("<a href='p"), i, F.lit("'>x</a>"))),
        F.when(n % 2 == 1, "<iframe src=frame></iframe>").otherwise(""), F.lit('<link rel=stylesheet href=s.css><link rel="next" href=more>'),
    )
    found = E.html_links(pages(spark, d).withColumn("html", html))
    both = found.select("page_id", F.explode(F.filter(F.array(F.when(F.col("inline"), True), F.when(F.col("linked"), False)), lambda x: x.isNotNull())).alias("inline"))
    return link_counts(both, "page_id")


@query(f"WITH {LINKS_SQL} SELECT DISTINCT page_id, link FROM links")
def links_set_distinct(spark, d):
    return anchor_links(spark, d).select("page_id", "link").distinct()


@query(f"WITH {LINKS_SQL} SELECT page_id, link FROM links UNION SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/robots.txt' FROM pages UNION SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/sitemap.xml' FROM pages")
def links_union_scrapers(spark, d):
    extra = pages(spark, d).select("page_id", F.explode(E.extra_urls(U.origin(F.col("url")))).alias("link"))
    return E.union_links(anchor_links(spark, d).select("page_id", "link"), extra)


@query(f"SELECT page_id, {CANONICAL_SQL} AS loc FROM pages")
def sitemap_extract(spark, d):
    loc = F.replace(U.canonical(F.col("url")), F.lit("&"), F.lit("&amp;"))
    body = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), loc, F.lit("</loc></url></urlset>"))
    return pages(spark, d).select("page_id", F.explode(E.sitemap_urls(body)).alias("loc"))


@query(f"WITH {LINKS_SQL}, first AS (SELECT link AS url, min(page_id * 100000 + pos) AS seq FROM links GROUP BY link) SELECT url, seq FROM first WHERE url NOT IN (SELECT {CANONICAL_SQL} FROM pages)")
def frontier_insert_ignore(spark, d):
    known = frontier(spark, d).withColumn("url", F.col("root_url"))
    links = anchor_links(spark, d).select((F.col("page_id") * 100_000 + F.col("pos")).alias("seq"), F.col("link").alias("url"))
    return fr.insert_new(known, links).select("url", "seq")


@query(f"WITH {FRONTIER_SQL} SELECT seq, CASE WHEN status = 'todo' AND level < 5 THEN 'in_progress' ELSE status END AS status, try_count FROM frontier")
def frontier_checkout_wave(spark, d):
    after, _ = fr.check_out(frontier(spark, d), "todo", level=5)
    return after.select("seq", "status", "try_count")


@query(f"WITH {FRONTIER_SQL} SELECT seq, url FROM frontier WHERE status = 'todo' ORDER BY seq LIMIT 10")
def frontier_checkout_first(spark, d):
    _, wave = fr.check_out(frontier(spark, d), limit=10)
    return wave.select("seq", "url")


@query(f"WITH {FRONTIER_SQL} SELECT seq, CASE WHEN status = 'in_progress' THEN CASE WHEN seq % 3 = 0 THEN 'error' ELSE 'done' END ELSE status END AS status, CAST(try_count + CASE WHEN status = 'in_progress' THEN 1 ELSE 0 END AS INTEGER) AS try_count FROM frontier")
def frontier_checkin(spark, d):
    rows = frontier(spark, d)
    results = rows.filter("status = 'in_progress'").select("url", F.when(F.col("seq") % 3 == 0, "error").otherwise("done").alias("new_status"))
    return fr.check_in(rows, results).select("seq", "status", "try_count")


@query(f"WITH {FRONTIER_SQL} SELECT seq, CASE WHEN status = 'in_progress' THEN 'todo' ELSE status END AS status FROM frontier")
def frontier_release(spark, d):
    return fr.release(frontier(spark, d)).select("seq", "status")


@query(f"WITH {FRONTIER_SQL} SELECT seq, url FROM frontier WHERE seq % 5 <> 0")
def frontier_remove(spark, d):
    rows = frontier(spark, d)
    return fr.remove(rows, rows.filter(F.col("seq") % 5 == 0)).select("seq", "url")


@query(f"WITH {FRONTIER_SQL} SELECT seq, CASE WHEN seq % 5 = 0 THEN 'todo' ELSE status END AS status FROM frontier")
def frontier_replace(spark, d):
    rows = frontier(spark, d)
    return fr.replace(rows, rows.filter(F.col("seq") % 5 == 0).select("seq", "url")).select("seq", "status")


@query(f"WITH {FRONTIER_SQL} SELECT count(*) AS n_urls, count(*) FILTER (status = 'todo' AND level = 0) AS n_root_todo FROM frontier")
def frontier_counts(spark, d):
    return fr.counts(frontier(spark, d))


@query(f"WITH {FRONTIER_SQL} SELECT status, count(*) AS n FROM frontier GROUP BY status")
def frontier_by_status(spark, d):
    return fr.by_status(frontier(spark, d))


@query(f"WITH {FRONTIER_SQL} SELECT DISTINCT {_HOST} AS hostname FROM frontier")
def frontier_hostnames(spark, d):
    return fr.hostnames(frontier(spark, d))


@query(f"WITH {FRONTIER_SQL} SELECT url, filename, 'todo' AS file_status FROM frontier WHERE status = 'done'")
def frontier_queued_files(spark, d):
    return fr.queued_files(frontier(spark, d))


@query(f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = node WHERE level < 5) SELECT node, CAST(min(level) AS INTEGER) AS level FROM w GROUP BY node")
def crawl_bfs_levels(spark, d):
    seeds = spark.range(1, 2).select(F.col("id").alias("node"))
    return CR.bfs_levels(graph(spark, d).select("src", "dst"), seeds, 5)


@query(
    f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = node WHERE level < 3 AND NOT inline) "
    "SELECT 'http://site.example/' || node AS url, CAST(min(level) AS INTEGER) AS level, 'done' AS status FROM w GROUP BY node"
)
def crawl_snapshot(spark, d):
    """A whole crawl by waves: recursion to depth 3, no page requisites."""
    edges = graph(spark, d).filter(~F.col("inline"))
    links = edges.select(page_key(F.col("src")).alias("url"), F.col("dst").alias("seq"), page_key(F.col("dst")).alias("link"), "inline", F.lit(None).cast("string").alias("link_type"))
    fetched = pages(spark, d).select(page_key(F.col("page_id")).alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"))
    seeds = spark.range(1, 2).select(F.col("id").alias("seq"), page_key(F.col("id")).alias("url"))
    done = CR.crawl(spark, seeds, links, fetched, CrawlConfig(recursive=True, level=3))
    return done.filter("status = 'done'").select("url", "level", "status")


@query(
    "WITH RECURSIVE c AS (SELECT page_id, page_id AS spot, 0 AS n FROM pages UNION ALL SELECT page_id, spot // 2, n + 1 FROM c WHERE spot > 0 AND spot % 2 = 0) "
    "SELECT 'http://site.example/' || page_id AS url, 'http://site.example/' || arg_max(spot, n) AS final_url, CAST(max(n) AS INTEGER) AS n_hops, true AS ended FROM c GROUP BY page_id"
)
def redirect_chain(spark, d):
    p = pages(spark, d).select("page_id")
    hops = p.filter("page_id > 0 AND page_id % 2 = 0").select(page_key(F.col("page_id")).alias("url"), page_key(F.floor(F.col("page_id") / 2)).alias("location"))
    return CR.redirect_chains(p.select(page_key(F.col("page_id")).alias("url")), hops)
