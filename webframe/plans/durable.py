"""Queries of crawls that go on, of rule tables, sitemap trees, table functions and politeness as a stream."""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webframe.config import CrawlConfig
from webframe.functions import tables
from webframe.functions import urls as U
from webframe.operators import crawl as CR
from webframe.operators import rule_tables, sitemaps
from webframe.plans.catalog import query
from webframe.plans.inputs import CANONICAL_SQL, FETCHES_SQL, GRAPH_SQL, LINKS_SQL, fetches, graph, linked_pages, page_key, pages
from webframe.session import checkpoint_dir, cut, remove, table
from webframe.streaming import politeness

_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"


@query(
    f"WITH RECURSIVE {GRAPH_SQL}, w AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN edges ON src = node WHERE level < 6 AND NOT inline) "
    "SELECT 'http://site.example/' || node AS url, CAST(min(level) AS INTEGER) AS level, 'done' AS status, CAST(1 AS INTEGER) AS try_count FROM w GROUP BY node"
)
def crawl_resume(spark, d):
    """A crawl that is stopped after two waves, and again after one, goes on with the frontier of its folder."""
    edges = graph(spark, d).filter(~F.col("inline"))
    links = edges.select(page_key(F.col("src")).alias("url"), F.col("dst").alias("seq"), page_key(F.col("dst")).alias("link"), "inline", F.lit(None).cast("string").alias("link_type"))
    fetched = pages(spark, d).select(page_key(F.col("page_id")).alias("url"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"))
    seeds = spark.range(1, 2).select(F.col("id").alias("seq"), page_key(F.col("id")).alias("url"))
    folder, config = f"{checkpoint_dir(spark)}/frontier-{uuid.uuid4().hex}", CrawlConfig(recursive=True, level=6)
    for waves in (2, 1, None):
        done = CR.run(spark, seeds, links, fetched, config, folder=folder, max_waves=waves, compact=3)
    rows = cut(done.frontier.select("url", "level", "status", "try_count"))
    remove(spark, folder)
    return rows


@query(
    f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), r AS (SELECT substring(host, 3) AS rule, page_id % 3 = 0 AS accept FROM h WHERE page_id % 7 = 0 UNION SELECT 'o' || o_orderkey || '.invalid', o_orderkey % 2 = 0 FROM orders), "
    "v AS (SELECT host, bool_or(accept) FILTER (ends_with(host, rule)) AS inside, bool_or(NOT accept) FILTER (ends_with(host, rule)) AS outside FROM (SELECT DISTINCT host FROM h), r GROUP BY host) "
    "SELECT page_id, NOT coalesce(outside, false) AND coalesce(inside, false) AS ok FROM h JOIN v USING (host)"
)
def filter_domain_table(spark, d):
    """Hosts against one rule for each order besides the ends of a seventh of the pages' hosts."""
    p = pages(spark, d).select("page_id", "url")
    ends = p.filter("page_id % 7 = 0").select(F.substring(U.hostname(F.col("url")), 3, 1000).alias("rule"), (F.col("page_id") % 3 == 0).alias("accept"))
    key = F.col("o_orderkey")
    many = table(spark, d, "orders").select(F.concat(F.lit("o"), key.cast("string"), F.lit(".invalid")).alias("rule"), (key % 2 == 0).alias("accept"))
    return rule_tables.domain_verdicts(p, ends.unionByName(many)).select("page_id", F.col("domain_ok").alias("ok"))


@query(
    f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), r AS (SELECT DISTINCT substring(path, 1, 8) AS head, '' AS tail, true AS accept FROM p WHERE page_id % 5 = 0 UNION SELECT DISTINCT '', right(path, 4), false FROM p WHERE page_id % 11 = 0), "
    "v AS (SELECT path, bool_or(accept) FILTER (fits) AS inside, bool_or(NOT accept) FILTER (fits) AS outside FROM (SELECT path, accept, starts_with(path, head) AND ends_with(path, tail) AS fits FROM (SELECT DISTINCT path FROM p), r) GROUP BY path) "
    "SELECT page_id, NOT coalesce(outside, false) AND coalesce(inside, false) AS ok FROM p JOIN v USING (path)"
)
def filter_path_table(spark, d):
    """Paths against patterns that are made of the pages' own beginnings and ends."""
    p = pages(spark, d).select("page_id", "url")
    path = U.path(F.col("url"))
    heads = p.filter("page_id % 5 = 0").select(F.concat(F.substring(path, 1, 8), F.lit("*")).alias("rule"), F.lit(True).alias("accept"))
    tails = p.filter("page_id % 11 = 0").select(F.concat(F.lit("*"), F.right(path, F.lit(4))).alias("rule"), F.lit(False).alias("accept"))
    many = table(spark, d, "orders").select(F.concat(F.lit("/none/"), F.col("o_orderkey").cast("string"), F.lit("/*")).alias("rule"), F.lit(True).alias("accept"))
    return rule_tables.path_verdicts(p, heads.unionByName(tails).unionByName(many)).select("page_id", F.col("path_ok").alias("ok"))


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode()))


@query(f"SELECT DISTINCT 'http://maps.example/leaf' || page_id % 100 || '.xml' AS sitemap, {CANONICAL_SQL} AS link FROM pages")
def sitemap_tree(spark, d):
    """robots.txt names an index of ten indexes of ten sitemaps each, every other one gzip; each index names the first again."""
    loc = lambda c: F.concat(F.lit("<loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    site = lambda name, k: F.concat(F.lit(f"http://maps.example/{name}"), k.cast("string"), F.lit(".xml"))
    wrap = lambda kind, inner: F.concat(F.lit(f'<?xml version="1.0"?><{kind}>'), inner, F.lit(f"</{kind}>"))
    leaf, n = F.col("page_id") % 100, F.col("id")
    leaves = pages(spark, d).groupBy(leaf.alias("k")).agg(wrap("urlset", F.array_join(F.collect_list(loc(U.canonical(F.col("url")))), "")).alias("text")).select(site("leaf", F.col("k")).alias("url"), F.col("k"), "text")
    names = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: loc(site("leaf", 10 * n + i))), "")
    indexes = spark.range(10).select(site("index", n).alias("url"), n.alias("k"), wrap("sitemapindex", F.concat(names, loc(F.lit("http://maps.example/root.xml")))).alias("text"))
    root = spark.range(1).select(F.lit("http://maps.example/root.xml").alias("url"), n.alias("k"), wrap("sitemapindex", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: loc(site("index", i))), "")).alias("text"))
    robots = spark.range(1).select(F.lit("http://maps.example/robots.txt").alias("url"), F.lit(1).cast("long").alias("k"), F.lit("User-agent: *\nSitemap: http://maps.example/root.xml\n").alias("text"))
    texts = leaves.unionByName(indexes).unionByName(root).unionByName(robots)
    bodies = texts.select("url", F.when(F.col("k") % 2 == 0, _zipped("text")).otherwise(F.col("text").cast("binary")).alias("body"))
    return sitemaps.follow(robots.select("url"), bodies).select("sitemap", "link")


@query(f"WITH {LINKS_SQL} SELECT DISTINCT page_id, link FROM links")
def links_sql(spark, d):
    """The links of pages by a table function in SQL."""
    tables.register(spark)
    linked_pages(spark, d).createOrReplaceTempView("webframe_linked_pages")
    found = spark.sql("SELECT page_id, l.link FROM webframe_linked_pages, LATERAL html_links(html, url) l WHERE l.tag = 'a' AND l.attrib = 'href'")
    return found.select("page_id", U.canonical(F.col("link")).alias("link")).distinct()


_STORE = "spark.sql.streaming.stateStore.providerClass"


@query(
    f"WITH {FETCHES_SQL}, i AS (SELECT *, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM fetches) "
    "SELECT CAST(user_id AS VARCHAR) AS host, epoch_us(ts) AS t, least(10.5::DOUBLE, 0.5::DOUBLE + sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS wait FROM i"
)
def polite_waits(spark, d):
    """The back-off of each user's fetches by the stateful stream, run over all events to its end."""
    folder = f"{checkpoint_dir(spark)}/polite-{uuid.uuid4().hex}"
    rows = fetches(spark, d).select(F.col("user_id").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"), "size", F.col("error").isNotNull().alias("failed"))
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        last = rows.agg(F.max("ts")).first()[0]
        for part in (rows, *(spark.range(1).select(F.lit("").alias("host"), (F.lit(last).cast("timestamp") + F.expr(f"INTERVAL {k} HOURS")).alias("ts"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("failed")) for k in (2, 4))):
            part.write.mode("append").parquet(f"{folder}/in")
            stream = politeness.polite(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), politeness.Rules(wait=0.5, waitretry=10), late="1 hour")
            stream.filter("host <> ''").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    done = cut(spark.read.schema(politeness.OUT).parquet(f"{folder}/out").select("host", "t", "wait"))
    remove(spark, folder)
    return done
