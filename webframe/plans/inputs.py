"""Inputs derived from the tables: link graph, fetch results, frontier rows, listings. SQL holds the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.functions import urls as U
from webframe.operators import extract as E
from webframe.session import table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with four more anchors in front: relative, in other quotes or none, and with userinfo, an IPv6 address,
    dot segments and characters to escape; behind marked sections, which are no markup of HTML."""
    n = F.col("page_id").cast("string")
    more = F.concat(
        F.lit("<a href='rel"), n, F.lit(".html'>1</a><A class=x HREF=?q="), n, F.lit(' >2</A><a title="a>b" href="../up/./'), n, F.lit('/x y">3</a><a\nhref = "//User:pw@[::1]:8080/A/../é?x=%c3#f">4</a>')
    )
    return pages(spark, sf_dir).withColumn("html", F.concat(more, "html"))


def anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, pos, href, link: the anchors of all pages, resolved."""
    p = linked_pages(spark, sf_dir)
    rows = p.select("page_id", "url", F.posexplode(E.anchor_hrefs(F.col("html"))).alias("pos", "href"))
    return rows.withColumn("link", U.resolved(F.col("url"), F.col("href")))


def escaped_sql(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) > 126 OR c = ' ' THEN url_encode(c) ELSE c END), '')"


LINKS_SQL = f"""
hrefs AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1) AS hs FROM pages),
dirs AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS page, regexp_extract(url, '^([^?#]*/)', 1) AS dir FROM pages),
links AS (
  SELECT page_id, url, i + 3 AS pos, hs[i] AS href,
    regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || {escaped_sql("regexp_extract(hs[i], '^([^#]*)', 1)")} AS link
  FROM (SELECT page_id, url, hs, unnest(generate_series(1, len(hs))) AS i FROM hrefs)
  UNION ALL SELECT page_id, url, 0, 'rel' || page_id || '.html', dir || 'rel' || page_id || '.html' FROM dirs
  UNION ALL SELECT page_id, url, 1, '?q=' || page_id, page || '?q=' || page_id FROM dirs
  UNION ALL SELECT page_id, url, 2, '../up/./' || page_id || '/x y', CASE WHEN regexp_matches(dir, '^[^:]+://[^/]+/$') THEN dir ELSE regexp_replace(dir, '[^/]*/$', '') END || 'up/' || page_id || '/x%20y' FROM dirs
  UNION ALL SELECT page_id, url, 3, '//User:pw@[::1]:8080/A/../é?x=%c3#f', regexp_extract(url, '^([^:]+)', 1) || '://User:pw@[::1]:8080/%C3%A9?x=%C3' FROM dirs
)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, inline: a fixed graph over page numbers."""
    p = pages(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    both = p.select("page_id").join(F.broadcast(n))  # one row
    edge = F.explode(F.array(F.struct(F.pmod(F.col("page_id") * 2, F.col("n")).alias("dst"), F.lit(False).alias("inline")), F.struct(F.pmod(F.col("page_id") * 3 + 1, F.col("n")).alias("dst"), (F.col("page_id") % 5 == 0).alias("inline"))))
    return both.select(F.col("page_id").alias("src"), edge.alias("e")).select("src", "e.dst", "e.inline")


GRAPH_SQL = """
n AS (SELECT count(*) AS n FROM pages),
edges AS (
  SELECT page_id AS src, (page_id * 2) % n AS dst, false AS inline FROM pages, n
  UNION ALL SELECT page_id, (page_id * 3 + 1) % n, page_id % 5 = 0 FROM pages, n
)"""


def page_key(n) -> F.Column:
    return F.concat(F.lit("http://site.example/"), n.cast("string"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, status_code, error, size of the events."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "click", 302).otherwise(200)
    error = F.when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "ConnectionRefused").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 1), "DNSNotFound").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 2), "AuthenticationError")
    return e.select("event_id", "ts", "user_id", code.alias("status_code"), error.alias("error"), F.floor(F.col("value") * 100).cast("long").alias("size"))


FETCHES_SQL = """
fetches AS (
  SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'click' THEN 302 ELSE 200 END AS status_code,
    CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'ConnectionRefused' WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'DNSNotFound'
         WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'AuthenticationError' END AS error,
    CAST(floor(value * 100) AS BIGINT) AS size
  FROM events
)"""


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier rows made from pages: statuses, tries and levels by page number."""
    status = F.when(F.col("page_id") % 4 == 0, "todo").when(F.col("page_id") % 4 == 1, "in_progress").when(F.col("page_id") % 4 == 2, "done").otherwise("error")
    u = U.canonical(F.col("url"))
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("seq"), F.concat(u, F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("parent_url"), u.alias("root_url"), status.alias("status"),
        (F.col("page_id") % 3).cast("int").alias("try_count"), (F.col("page_id") % 7).cast("int").alias("level"), F.when(F.col("page_id") % 5 == 0, (F.col("page_id") % 4).cast("int")).alias("inline_level"),
        F.lit(None).cast("string").alias("link_type"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("post_data"), F.lit(None).cast("int").alias("status_code"),
        F.when(F.col("page_id") % 4 == 2, F.concat(F.lit("f"), F.col("page_id").cast("string"))).alias("filename"),
    )


CANONICAL_SQL = "regexp_extract(url, '^([^#]*)', 1)"
FRONTIER_SQL = f"""
frontier AS (
  SELECT page_id AS seq, {CANONICAL_SQL} || '#' || page_id AS url, {CANONICAL_SQL} AS root_url,
    CASE page_id % 4 WHEN 0 THEN 'todo' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'done' ELSE 'error' END AS status,
    CAST(page_id % 3 AS INTEGER) AS try_count, CAST(page_id % 7 AS INTEGER) AS level,
    CASE WHEN page_id % 5 = 0 THEN CAST(page_id % 4 AS INTEGER) END AS inline_level, CASE WHEN page_id % 4 = 2 THEN 'f' || page_id END AS filename
  FROM pages
)"""
