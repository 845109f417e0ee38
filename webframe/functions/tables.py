"""Table functions for SQL: ``SELECT l.* FROM pages, LATERAL html_links(html, url) l``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

LINKS = "tag string, attrib string, link string, inline boolean, linked boolean, link_type string"


@udtf(returnType=LINKS, useArrow=True)
class HtmlLinks:
    """The links of an HTML text at a URL, resolved and each once."""

    def eval(self, html: str, url: str):
        from webframe.operators.extract import document_links

        if html is not None and url is not None:
            for _, tag, attrib, link, inline, linked, kind, _ in document_links(html, url):
                yield tag, attrib, link, inline, linked, kind


@udtf(returnType="link string, link_type string", useArrow=True)
class CssLinks:
    """The links of a style sheet at a URL, resolved."""

    def eval(self, css: str, url: str):
        from webframe.functions.urls import join_url
        from webframe.operators.extract import css_links

        for link, kind in css_links(css or ""):
            target = join_url(url, link) if url else None
            if target:
                yield target, kind


@udtf(returnType="link string", useArrow=True)
class ScriptLinks:
    """The string literals of a script that look like links, resolved against a URL."""

    def eval(self, script: str, url: str):
        from webframe.functions.urls import join_url
        from webframe.operators.extract import script_links

        for link in script_links(script or ""):
            target = join_url(url, link) if url else None
            if target:
                yield (target,)


FUNCTIONS = {"html_links": HtmlLinks, "css_links": CssLinks, "script_links": ScriptLinks}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
