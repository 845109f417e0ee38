"""Scrapers over documents: which of them run, on what, and how their links are put together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import text as X
from webframe.functions import urls as U
from webframe.operators import extract as E

LINKS = "url string, scraper string, link string, inline boolean, linked boolean, link_type string"


@dataclass(frozen=True)
class Scraper:
    """``links`` takes documents (url, body) and gives (url, link, inline, linked, link_type); ``link_type`` is what a
    document was expected to be for the scraper to look at it, ``accepts`` whether it looks like it."""

    name: str
    link_type: str
    accepts: Callable[[Column, Column, Column], Column]
    links: Callable[[DataFrame], DataFrame]


def _from_html(config: CrawlConfig) -> Callable[[DataFrame], DataFrame]:
    def links(documents: DataFrame) -> DataFrame:
        found = E.html_links(documents.select(F.col("url").alias("page"), "url", "body"), "page", "url", "body", css="css" in config.link_extractors, scripts="javascript" in config.link_extractors, follow_tags=config.follow_tags, ignore_tags=config.ignore_tags, only_relative=config.relative)
        return found.select(F.col("page").alias("url"), "link", "inline", "linked", "link_type")

    return links


def _from_css(documents: DataFrame) -> DataFrame:
    rows = documents.select("url", F.explode(E.css_urls(F.col("body"))).alias("x"))
    return rows.select("url", U.resolved(F.col("url"), F.col("x.link")).alias("link"), F.lit(True).alias("inline"), F.lit(False).alias("linked"), "x.link_type")


def _from_javascript(documents: DataFrame) -> DataFrame:
    from webframe.functions import links as L

    rows = documents.select("url", F.explode(E.script_strings(F.col("body"))).alias("x"))
    inline = L.is_likely_inline(F.col("x"))
    return rows.select("url", U.resolved(F.col("url"), F.col("x")).alias("link"), inline.alias("inline"), (~inline).alias("linked"), L.link_type(F.col("x")).alias("link_type"))


def _from_sitemap(documents: DataFrame) -> DataFrame:
    rows = documents.select("url", F.explode(E.sitemap_urls(F.col("body"))).alias("x"))
    return rows.select("url", U.resolved(F.col("url"), F.col("x")).alias("link"), F.lit(False).alias("inline"), F.lit(True).alias("linked"), F.lit(None).cast("string").alias("link_type"))


def assemble(config: CrawlConfig) -> list[Scraper]:
    """HTML always, CSS and JavaScript as asked for, sitemaps where they are followed."""
    every = [
        Scraper("html", "html", X.is_html, _from_html(config)),
        Scraper("css", "css", X.is_css, _from_css),
        Scraper("javascript", "javascript", X.is_javascript, _from_javascript),
        Scraper("sitemap", "sitemap", lambda kind, body, path: X.is_sitemap(body, path), _from_sitemap),
    ]
    asked = {"html", *config.link_extractors} | ({"sitemap"} if config.sitemaps else set())
    return [s for s in every if s.name in asked]


def _looked_at(documents: DataFrame, scraper: Scraper) -> DataFrame:
    """The documents that are expected to be of the scraper's type, or of no known one, and that look like it."""
    expected = F.col("link_type").isNull() | (F.col("link_type") == scraper.link_type)
    return documents.filter(expected & scraper.accepts(F.col("content_type"), F.col("body"), U.path(F.col("url"))))


def scrape(documents: DataFrame, scrapers: list[Scraper], first_only: bool = False) -> DataFrame:
    """LINKS of ``documents`` (url, content_type, body, link_type), each link of a scraper once. With ``first_only`` a
    document's links are those of the first scraper that finds any: an aggregate over (url, rank), no sort."""
    out = None
    for rank, s in enumerate(scrapers):
        found = s.links(_looked_at(documents, s).select("url", "body")).filter(F.col("link").isNotNull())
        found = found.select("url", F.lit(rank).alias("rank"), F.lit(s.name).alias("scraper"), "link", "inline", "linked", "link_type").distinct()
        out = found if out is None else out.unionByName(found)
    if first_only:
        least = out.groupBy("url").agg(F.min("rank").alias("rank"))
        out = out.join(least, ["url", "rank"], "left_semi")
    return out.drop("rank")


def segments(text: Column, pattern: str) -> Column:
    """array<struct<text, is_link>> that covers the whole text: its parts that match and those between them."""
    part = lambda x, is_link: F.struct(x.alias("text"), F.lit(is_link).alias("is_link"))
    pairs = F.zip_with(_between(text, pattern), _matches(text, pattern), lambda b, f: F.array(part(b, False), part(f, True)))
    return F.filter(F.flatten(pairs), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)({pattern})"), F.lit(1))


def _between(text: Column, pattern: str) -> Column:
    return F.split(text, f"(?s){pattern}", -1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named: within lambdas Spark joins no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(text: Column, pattern: str, chunk: int = 16_384, overlap: int = 4_096) -> Column:
    """array of the matches of ``pattern`` found in chunks, for values so long that patterns shouldn't go over them at once.

    A fold over chunks, each with the next ``overlap`` characters, whose state is how many characters of the next chunk are
    passed: a match that begins in a chunk is its own and may reach into the overlap; the next chunk is read from where the
    last match ended. Matches up to ``overlap`` are those of the whole text; a pattern sees nothing before the place it is
    read from. Empty matches aren't told. A fold copies its state with each chunk, so it holds numbers; matches follow.
    """
    windows = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{1,{chunk + overlap}}}+)).{{1,{chunk}}}+"), F.lit(1))
    begin = F.struct(F.lit(0).cast("long").alias("skip"), F.array().cast("array<long>").alias("places"))
    high = lambda x: F.shiftright(x, 32)
    low = lambda x: x.bitwiseAND((1 << 32) - 1)
    pair = lambda x, y: F.shiftleft(x.cast("long"), 32) + y
    rest = lambda window, skip: F.substr(window, skip.cast("int") + 1, F.lit(chunk + overlap))

    def one(state: Column, window: Column) -> Column:
        skip = state["skip"]
        read, own = rest(window, skip), F.lit(chunk) - skip
        pairs = F.zip_with(_between(read, pattern), _matches(read, pattern), lambda b, m: pair(F.coalesce(F.length(b), F.lit(0)), F.length(m)))

        def step(a: Column, p: Column) -> Column:
            """How many matches begin in the chunk (high half) and where the last one ends; below 0 once one lies behind it."""
            return F.when((a < 0) | p.isNull(), a).when(low(a) + high(p) < own, a + (1 << 32) + high(p) + low(p)).otherwise(-1 - a)

        found = F.aggregate(pairs, F.lit(0).cast("long"), step, lambda a: F.when(a < 0, -1 - a).otherwise(a))
        return _once(found, lambda a: F.struct(F.greatest(low(a) - own, F.lit(0)).alias("skip"), F.concat(state["places"], F.array(pair(high(a), skip))).alias("places")))

    places = F.aggregate(windows, begin, one)["places"]
    own = F.zip_with(windows, places, lambda w, p: F.slice(_matches(rest(w, low(p)), pattern), F.lit(1), high(p).cast("int")))
    return F.array_remove(F.flatten(own), "")
