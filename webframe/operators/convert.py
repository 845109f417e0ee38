"""Link conversion of saved documents: links to saved URLs become file names, others absolute URLs.

Link texts of all documents are distinct rows that meet the frontier in one equi-join; only the small map of each
document's own replacements goes back to it, and the rewriting is a narrow map.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.functions.urls import join_url, try_parse_url
from webframe.operators.extract import CSS_IMPORT, CSS_URL, LINK_ATTRIBUTES

_ATTRIBUTE = re.compile(r"""(?is)(\s(?:%s)\s*=\s*)("[^"]*"|'[^']*')""" % "|".join(sorted(LINK_ATTRIBUTES)))
_TAG = re.compile(r"(?s)<[a-zA-Z][^>]*>")
_CSS = re.compile(f"{CSS_URL}|{CSS_IMPORT}")


def lookup(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """``links`` (base, link) with target, filename and new_url."""
    saved = frontier.filter((F.col("status") == "done") & F.col("filename").isNotNull()).select(F.col("url").alias("target"), "filename")
    return links.join(saved, "target", "left").withColumn("new_url", F.coalesce("filename", "target"))


def relative_name(from_file: str, to_file: str) -> str:
    import posixpath

    return posixpath.relpath(to_file, posixpath.dirname(from_file) or ".")


def _targets(kind: str, url: str, body: str) -> list[tuple[str, str]]:
    raw = []
    if kind == "css":
        raw = [m[3] or m[2] for m in _CSS.finditer(body)]
    else:
        for tag in _TAG.finditer(body):
            raw += [m[2][1:-1] for m in _ATTRIBUTE.finditer(tag[0])]
    out = []
    for link in dict.fromkeys(raw):
        info = try_parse_url(join_url(url, link)) if link and not link.startswith(("#", "javascript:", "data:")) else None
        if info:
            out.append((link, info["url"]))
    return out


def _rewrite(kind: str, body: str, new: dict[str, str]) -> str:
    if kind == "css":
        return _CSS.sub(lambda m: m[0].replace(m[3] or m[2], new.get(m[3] or m[2], m[3] or m[2])), body)
    swap = lambda m: m[1] + m[2][0] + new.get(m[2][1:-1], m[2][1:-1]) + m[2][0]
    return _TAG.sub(lambda t: _ATTRIBUTE.sub(swap, t[0]), body)


def convert_documents(documents: DataFrame, frontier: DataFrame) -> DataFrame:
    """``documents`` (url, kind, filename, body) with ``converted``."""

    def find(batches):
        for pdf in batches:
            rows = [(u, f, link, target) for u, k, f, b in pdf.itertuples(index=False) for link, target in _targets(k, u, b or "")]
            yield pd.DataFrame(rows, columns=["url", "own_file", "link", "target"])

    links = documents.select("url", "kind", "filename", "body").mapInPandas(find, "url string, own_file string, link string, target string")
    found = lookup(links, frontier).groupBy("url").agg(F.collect_list(F.struct("link", "filename", "target")).alias("__links"))

    def rewrite(batches):
        for pdf in batches:
            done = []
            for kind, own, body, links in pdf[["kind", "filename", "body", "__links"]].itertuples(index=False):
                new = {x["link"]: relative_name(own, x["filename"]) if x["filename"] else x["target"] for x in (links if links is not None else ())}
                done.append(_rewrite(kind, body or "", new))
            yield pdf.drop(columns="__links").assign(converted=done)

    joined = documents.select("url", "kind", "filename", "body").join(found, "url", "left")
    return joined.mapInPandas(rewrite, "url string, kind string, filename string, body string, converted string")
