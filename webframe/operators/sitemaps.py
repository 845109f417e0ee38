"""Trees of sitemaps: indexes followed to the pages that their leaves name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions import text as X
from webframe.functions import urls as U
from webframe.operators.extract import sitemap_urls
from webframe.session import cut

_FOUND = "root string, sitemap string, link string"


def follow(roots: DataFrame, bodies: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """(root, sitemap, link): the pages that ``roots`` (url) lead to, with the sitemap that names each.

    ``bodies`` (url, body): bytes of sitemaps and of robots.txt, gzip or not, unique by URL. What a ``sitemapindex`` or a
    robots.txt names are sitemaps in their turn; one that a root has led to already is not read again, so circles end.
    Each level is one equi-join of its URLs with the bodies; those that aren't there or aren't sitemaps name nothing.
    """
    spark = roots.sparkSession
    text = X.page_text(F.col(body_col).cast("binary"))
    pages = bodies.select(F.col(url_col).alias("sitemap"), text.alias("text"))
    last = cut(roots.select(U.canonical(F.col(url_col)).alias("sitemap")).distinct().select(F.col("sitemap").alias("root"), "sitemap"))
    seen, out = last, spark.createDataFrame([], _FOUND)
    while True:
        is_map = X.is_sitemap(F.col("text"), F.lit(""))
        robots = U.path(F.col("sitemap")) == "/robots.txt"
        read = last.join(pages, "sitemap").filter(is_map | robots)
        names = F.when(robots & ~is_map, sitemap_urls(F.col("text"))).otherwise(F.when(is_map, sitemap_urls(F.col("text"))))
        is_index = robots | F.col("text").contains("<sitemapindex")
        links = cut(read.select("root", "sitemap", is_index.alias("is_index"), F.explode(names).alias("link")).withColumn("link", U.resolved(F.col("sitemap"), F.col("link"))).filter(F.col("link").isNotNull()))
        out = out.unionByName(links.filter(~F.col("is_index")).select("root", "sitemap", "link"))
        more = links.filter("is_index").select("root", F.col("link").alias("sitemap")).distinct().join(seen, ["root", "sitemap"], "left_anti")
        last = cut(more)
        if not last.limit(1).count():
            return out.distinct()
        seen = cut(seen.unionByName(last))
