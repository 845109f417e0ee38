"""Queries of filters, robots and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import urls as U
from webframe.operators import filters as P
from webframe.operators import hooks as H
from webframe.operators import robots
from webframe.plans.catalog import query
from webframe.plans.inputs import FRONTIER_SQL, LINKS_SQL, anchor_links, frontier, pages

_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"


def _records(spark, d):
    return P.record_columns(frontier(spark, d).withColumn("url", F.regexp_extract("url", "^([^#]*)", 1)))


@query("SELECT page_id FROM pages WHERE url LIKE 'http:%' OR url LIKE 'https:%'")
def filter_scheme(spark, d):
    return pages(spark, d).withColumn("scheme", U.scheme(F.col("url"))).filter(P.scheme_filter()).select("page_id")


@query("SELECT page_id FROM pages WHERE url LIKE 'https:%'")
def filter_https_only(spark, d):
    return pages(spark, d).withColumn("scheme", U.scheme(F.col("url"))).filter(P.https_only()).select("page_id")


@query(f"SELECT page_id FROM pages WHERE ({_HOST} LIKE '%example.com' OR {_HOST} LIKE '%example.org') AND NOT {_HOST} LIKE '%spam-farm.example.org'")
def filter_domain_suffix(spark, d):
    return pages(spark, d).withColumn("hostname", U.hostname(F.col("url"))).filter(P.domains(("example.com", "example.org"), ("spam-farm.example.org",))).select("page_id")


@query(f"SELECT page_id FROM pages WHERE {_HOST} IN ('spam-farm.example.org', 'www.cheap-pills.example.com') OR {_HOST} = 'blog.tionsh.example.net'")
def filter_hostname(spark, d):
    return pages(spark, d).withColumn("hostname", U.hostname(F.col("url"))).filter(P.hostnames(("spam-farm.example.org", "www.cheap-pills.example.com", "blog.tionsh.example.net"), ("other.example",))).select("page_id")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]+') AND NOT regexp_matches(url, 'utm_')")
def filter_regex(spark, d):
    return pages(spark, d).filter(P.regex("/(en|fr)/[0-9]+", "utm_")).select("page_id")


@query(f"SELECT page_id FROM pages WHERE regexp_matches({_PATH} || CASE WHEN {_PATH} LIKE '%/' THEN '' ELSE '/' END, '^/(en|fr)/.*/$') AND NOT regexp_matches({_PATH}, '^/en/9')")
def filter_directory(spark, d):
    rows = pages(spark, d).withColumn("path", U.path(F.col("url")))
    return rows.filter(P.directories(("/en/*", "/fr/*"), ("/en/9*",))).select("page_id")


@query(f"SELECT page_id FROM pages WHERE {_PATH} LIKE '%/' OR ({_PATH} LIKE '%.html' OR regexp_matches({_PATH}, '[0-4]$')) AND NOT regexp_matches({_PATH}, '7[^/]html$')")
def filter_filename(spark, d):
    rows = pages(spark, d).withColumn("path", U.path(F.col("url")))
    return rows.filter(P.filenames(("*.html", "[0-4]"), ("7?html",))).select("page_id")


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, {_HOST} <> regexp_extract(link, '^[^:]+://([^/?#]*)', 1) OR link LIKE regexp_extract(url, '^([^#?]*/)', 1) || '%' AS ok FROM links")
def filter_parent(spark, d):
    rows = anchor_links(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("link"), F.col("url").alias("root_url"), F.col("url").alias("parent_url"), F.lit(None).cast("int").alias("inline_level")).withColumnRenamed("link", "url")
    return P.record_columns(rows).select("page_id", "pos", P.parent().alias("ok"))


@query(f"WITH seeds AS (SELECT DISTINCT {_HOST} AS h FROM pages WHERE page_id % 10 = 0) SELECT page_id, {_HOST} IN (SELECT h FROM seeds) OR page_id % 5 = 0 AS ok FROM pages")
def filter_span_hosts(spark, d):
    rows = pages(spark, d).select("page_id", "url", F.lit(None).cast("string").alias("parent_url"), F.col("url").alias("root_url"), F.when(F.col("page_id") % 5 == 0, 1).alias("inline_level"))
    flagged = P.with_seed_flags(P.record_columns(rows), pages(spark, d).filter(F.col("page_id") % 10 == 0))
    return flagged.select("page_id", P.span_hosts(page_requisites=True).alias("ok"))


@query(
    f"WITH {FRONTIER_SQL} SELECT seq, coalesce(inline_level, 0) <= 2 AND level <= 3 + CASE WHEN inline_level > 0 THEN 2 ELSE 0 END AS level_ok, try_count < 2 AS tries_ok, "
    "CASE WHEN level = 0 THEN true WHEN inline_level > 0 THEN false ELSE true END AS recursive_ok FROM frontier"
)
def filter_level_tries(spark, d):
    return frontier(spark, d).select("seq", P.levels(3, 2).alias("level_ok"), P.tries(2).alias("tries_ok"), P.recursive(True, False).alias("recursive_ok"))


@query(
    f"WITH {FRONTIER_SQL}, t AS (SELECT seq, root_url LIKE 'https:%' AS https, level = 0 OR coalesce(inline_level, 0) = 0 AS rec, try_count < 2 AS tries, "
    "coalesce(inline_level, 0) <= 5 AND level <= 4 + CASE WHEN inline_level > 0 THEN 2 ELSE 0 END AS lev, root_url LIKE '%example.com%' AS dom FROM frontier), "
    "v AS (SELECT *, https::INT + rec::INT + tries::INT + lev::INT + dom::INT AS passed FROM t) "
    "SELECT seq, passed = 5 AS verdict, 'filters' AS reason, CAST(passed + 2 AS INTEGER) AS n_passed, CAST(5 - passed AS INTEGER) AS n_failed FROM v"
)
def filter_verdict_map(spark, d):
    config = CrawlConfig(recursive=True, level=4, tries=2, https_only=True, accept_regex=r"example\.com", span_hosts=True)
    tests = P.assemble(config)
    rows = _records(spark, d).withColumns({"in_seeds": F.lit(True), "parent_in_seeds": F.lit(True)}).select("seq", P.verdict(tests).alias("v"))
    return rows.select("seq", "v.verdict", "v.reason", F.size("v.passed").alias("n_passed"), F.size("v.failed").alias("n_failed"))


@query(f"SELECT page_id, {_HOST} LIKE 'm.%' OR page_id % 3 = 0 AS verdict, CASE WHEN {_HOST} LIKE 'm.%' THEN 'filters' WHEN page_id % 3 = 0 THEN 'redirect' ELSE 'filters' END AS reason FROM pages")
def filter_strong_redirect(spark, d):
    rows = pages(spark, d).withColumns({"in_seeds": U.hostname(F.col("url")).startswith("m."), "parent_in_seeds": F.lit(False), "inline_level": F.lit(None).cast("int"), "scheme": U.scheme(F.col("url"))})
    v = P.verdict({"SchemeFilter": P.scheme_filter(), "SpanHostsFilter": P.span_hosts()}, F.col("page_id") % 3 == 0)
    return rows.select("page_id", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: webframe\nDisallow: /en/ # no English\nAllow: /en/1*\nDisallow: /*.html$\nDisallow:\n"


@query(f"SELECT page_id, CASE WHEN {_HOST} NOT LIKE '%example.com' THEN true WHEN regexp_matches({_PATH}, '^/en/1') THEN CASE WHEN regexp_matches(url, '^[^?]*\\.html$') THEN false ELSE true END WHEN regexp_matches({_PATH}, '^/en/') THEN false WHEN regexp_matches(regexp_extract(url, '^([^#]*)', 1), '\\.html$') THEN false ELSE true END AS ok FROM pages")
def robots_verdict(spark, d):
    p = pages(spark, d)
    files = p.select(U.origin(F.col("url")).alias("origin")).distinct().filter(F.col("origin").endswith("example.com")).withColumn("body", F.lit(_ROBOTS))
    return robots.allowed(p.select("page_id", "url"), robots.rules(files), "webframe").select("page_id", F.col("robots_ok").alias("ok"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url LIKE 'https:%' ELSE url LIKE '%/en/%' END AS verdict, CASE WHEN page_id % 3 = 0 THEN 'filters' ELSE 'callback_hook' END AS reason FROM pages")
def hook_accept_url(spark, d):
    """The hook decides, and leaves a third of the pages to the filters."""
    hooks = H.Hooks()
    hooks.connect("accept_url", lambda url, verdict, reason, results: F.when(F.col("page_id") % 3 != 0, url.contains("/en/")))
    rows = pages(spark, d).withColumn("scheme", U.scheme(F.col("url")))
    v = P.with_hook(P.verdict({"HTTPSOnlyFilter": P.https_only()}), hooks.callbacks["accept_url"][0])
    return rows.select("page_id", v["verdict"].alias("verdict"), v["reason"].alias("reason"))


@query("SELECT page_id, url || '&extra=' || i AS link FROM pages, (SELECT unnest([1, 2]) AS i)")
def hook_get_urls(spark, d):
    hooks = H.Hooks()
    hooks.connect("get_urls", lambda df: df.select("page_id", F.explode(F.array(F.concat("url", F.lit("&extra=1")), F.concat("url", F.lit("&extra=2")))).alias("link")))
    return H.more_urls(pages(spark, d), hooks)


@query("SELECT p.page_id, CASE WHEN NOT (p.url LIKE 'http:%' AND q.url LIKE 'https:%') THEN q.url END AS referer FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id // 2")
def referer_suppression(spark, d):
    """Each page is reached from the page of half its number."""
    p = pages(spark, d).select("page_id", "url")
    parents = p.select(F.col("page_id").alias("half"), F.col("url").alias("parent"))
    met = p.join(parents, F.floor(F.col("page_id") / 2) == F.col("half"), "left")
    return met.select("page_id", P.referer(F.col("url"), F.col("parent")).alias("referer"))
