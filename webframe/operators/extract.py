"""Links from HTML, CSS, JavaScript and sitemaps.

HTML needs a tokenizer: :func:`html_links` runs one over Arrow batches. CSS URLs, script strings and sitemaps are regular
expressions or XPath in the JVM. A link is (ordinal, tag, attrib, link, inline, linked, link_type, value_type).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions import links as L
from webframe.functions.urls import join_url

EMBEDDED, PAGE, BOTH = "embedded", "page", "both"
#: pages whose links are made at once
PAGES = 64

# Link attributes; what each attribute of an element leads to; begins of script attributes; properties of
# Open Graph and Twitter; elements whose text can be a link; patterns of CSS and JavaScript.
LINK_ATTRIBUTES = frozenset(["action", "archive", "background", "cite", "classid", "codebase", "data", "dynsrc", "href", "longdesc", "lowsrc", "profile", "src", "usemap"])
KINDS = {
    ("a", "href"): PAGE, ("applet", "code"): EMBEDDED, ("area", "href"): PAGE, ("bgsound", "src"): EMBEDDED, ("body", "background"): EMBEDDED, ("embed", "href"): PAGE, ("embed", "src"): BOTH,
    ("fig", "src"): EMBEDDED, ("form", "action"): PAGE, ("frame", "src"): BOTH, ("iframe", "src"): BOTH, ("img", "href"): EMBEDDED, ("img", "lowsrc"): EMBEDDED, ("img", "src"): EMBEDDED,
    ("input", "src"): EMBEDDED, ("layer", "src"): BOTH, ("object", "data"): EMBEDDED, ("overlay", "src"): BOTH, ("script", "src"): EMBEDDED, ("table", "background"): EMBEDDED,
    ("td", "background"): EMBEDDED, ("th", "background"): EMBEDDED,
}
SCRIPT_ATTRIBUTES = ("onkey", "oncli", "onmou")
MEDIA_PROPERTIES = ("og:image", "og:audio", "og:video", "twitter:image:src", "twitter:image0", "twitter:image1", "twitter:image2", "twitter:image3", "twitter:player:stream")
LINK_PROPERTIES = ("og:url", "twitter:player")
TEXT_TAGS = ("style", "script", "link", "url", "icon")
CSS_URL = r"""url\(\s*(['"]?)(.{1,500}?)(?:\1)\s*\)"""
CSS_IMPORT = r"""@import\s*(?:url\()?['"]?([^\s'")]{1,500}).*?;"""
JS_STRING = r"""(\\{0,8}['"])(https?://[^'"]{1,500}|[^\s'"]{1,500})(?:\1)"""
# End of fixed values.

_CSS = re.compile(f"{CSS_URL}|{CSS_IMPORT}")
_JS = re.compile(JS_STRING)

FIELDS = "ordinal int, tag string, attrib string, link string, inline boolean, linked boolean, link_type string, value_type string"


def css_links(css: str) -> Iterator[tuple[str, str]]:
    """(link, css or media)"""
    for m in _CSS.finditer(css):
        link = m[3] or m[2]
        if link and len(link) < 500:
            yield link, "css" if m[3] else "media"


def script_links(script: str) -> Iterator[str]:
    for m in _JS.finditer(script):
        try:
            text = json.loads(f'"{m[2]}"')
        except ValueError:
            continue
        if not L.unlikely_link(text) and L.likely_link(text):
            yield text


def _soup(link: str) -> str:
    return "".join(line.strip().replace("\t", "") for line in link.splitlines())


def refresh_target(content: str) -> str | None:
    m = re.search(r"url\s*=(.+)", content, re.I)
    if not m:
        return None
    url = m[1]
    return _soup(url.strip(url[0]) if url[0] in "\"'" else url)


class _Walker(HTMLParser):
    """Collects elements with the text of the few tags whose text can hold links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.open: list[int] = []
        self.base: str | None = None
        self.nofollow = False

    def parse_marked_section(self, i, report=1):
        """``<![`` is no markup of HTML: a comment up to the next ``>``, after which reading goes on."""
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        attrib: dict[str, str] = {}
        for k, v in attrs:
            attrib.setdefault(k, v or "")
        self.elements.append([tag, attrib, ""])
        if tag in TEXT_TAGS:
            self.open.append(len(self.elements) - 1)
        if tag == "base" and self.base is None and attrib.get("href"):
            self.base = attrib["href"]
        if tag == "meta" and attrib.get("name", "").lower() == "robots" and "nofollow" in (attrib.get("content") or attrib.get("value") or "").lower():
            self.nofollow = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in TEXT_TAGS:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in TEXT_TAGS and self.open and self.elements[self.open[-1]][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        if self.open and (self.elements[self.open[-1]][0] in ("style", "script") or len(self.elements) - 1 == self.open[-1]):
            self.elements[self.open[-1]][2] += data


def _attribute_links(tag: str, attrib: dict[str, str], scripts: bool) -> Iterator[tuple[str, str]]:
    for name, value in attrib.items():
        if name in LINK_ATTRIBUTES:
            if scripts and value.lstrip().startswith("javascript:"):
                yield from ((name, x) for x in script_links(unquote(value)))
            else:
                yield name, value
        elif scripts and name[:5] in SCRIPT_ATTRIBUTES:
            yield from ((name, x) for x in script_links(value))
        elif name.startswith("data-"):
            if L.likely_link(value) and not L.unlikely_link(value):
                yield name, value
        elif name == "srcset":
            yield from ((name, x.lstrip().split(" ", 1)[0]) for x in value.split(","))


class Found(NamedTuple):
    """A link before it is resolved: ``base`` is the element's own one."""

    attrib: str | None
    link: str
    inline: bool
    linked: bool
    link_type: str | None
    value_type: str = "plain"
    base: str | None = None


@dataclass(frozen=True)
class Element:
    tag: str
    attrib: dict[str, str]
    text: str
    css: bool
    scripts: bool

    def attributes(self) -> Iterator[tuple[str, str]]:
        return _attribute_links(self.tag, self.attrib, self.scripts)


def _type_of(link: str) -> str | None:
    return L.link_type_of(_soup(link))


def _embedded(name: str | None, link: str, value_type: str = "plain", base: str | None = None) -> Found:
    return Found(name, link, True, False, _type_of(link), value_type, base)


def _guessed(name: str | None, link: str, value_type: str = "plain") -> Found:
    """A link of which only its text tells what it is."""
    inline = L.likely_inline(link)
    return Found(name, link, inline, not inline, _type_of(link), value_type)


def _of_attributes(e: Element) -> Iterator[Found]:
    for name, link in e.attributes():
        if name not in LINK_ATTRIBUTES:
            yield _guessed(name, link)
            continue
        kind = KINDS.get((e.tag, name), PAGE if name == "href" else EMBEDDED)
        yield Found(name, link, kind != PAGE, kind != EMBEDDED, _type_of(link))


def _of_relation(e: Element) -> Iterator[Found]:
    relation = e.attrib.get("rel", "")
    kind = next((k for word, k in (("stylesheet", "css"), ("icon", "media")) if word in relation), None)
    for name, link in e.attributes():
        yield Found(name, link, kind is not None, kind is None, kind)


def _of_meta(e: Element) -> Iterator[Found]:
    content = e.attrib.get("content") or ""
    if e.attrib.get("http-equiv", "").lower() == "refresh":
        if target := refresh_target(content):
            yield Found("http-equiv", target, False, True, None, "refresh")
        return
    for known, kind in ((MEDIA_PROPERTIES, "media"), (LINK_PROPERTIES, None)):
        if content and e.attrib.get("property", "").lower() in known:
            yield Found("property", content, False, True, kind)


def _of_plugin(e: Element) -> Iterator[Found]:
    base = e.attrib.get("codebase") or None
    if base:
        yield Found("codebase", base, True, False, None)
    parts = {name: [e.attrib[name]] for name in ("code", "src", "classid", "data") if name in e.attrib} | {"archive": e.attrib.get("archive", "").split()}
    for name, links in parts.items():
        yield from (_embedded(name, link, "list" if name == "archive" else "plain", base) for link in links)


def _of_parameter(e: Element) -> Iterator[Found]:
    if e.attrib.get("valuetype", "").lower() == "ref" and "value" in e.attrib:
        yield _embedded("value", e.attrib["value"])


def _of_style(e: Element) -> Iterator[Found]:
    if e.css:
        yield from (Found(None, link, True, False, kind, "css") for link, kind in css_links(e.text))


def _of_script(e: Element) -> Iterator[Found]:
    if e.scripts:
        yield from (_guessed(None, link, "script") for link in script_links(e.text))


def _of_link_text(e: Element) -> Iterator[Found]:
    if e.text:
        yield Found(None, e.text, False, True, _type_of(e.text))


def _of_style_attribute(e: Element) -> Iterator[Found]:
    if e.css:
        yield from (Found("style", link, True, False, "media", "css") for link, _ in css_links(e.attrib.get("style", "")))


#: The rules of each element, in order; those of ANY_TAG for elements without rules of their own.
ANY_TAG = (_of_attributes,)
RULES = {
    "link": (_of_relation, _of_link_text),
    "meta": (_of_meta,),
    "object": (_of_plugin,),
    "applet": (_of_plugin,),
    "param": (_of_parameter,),
    "style": (_of_style,),
    "script": (_of_script, _of_attributes),
    "url": (_of_attributes, _of_link_text),
    "icon": (_of_attributes, _of_link_text),
}


def element_links(e: Element) -> Iterator[Found]:
    for rule in (*RULES.get(e.tag, ANY_TAG), _of_style_attribute):
        yield from rule(e)


def document_links(html: str, url: str, refresh: str | None = None, css: bool = True, scripts: bool = True, follow_tags=(), ignore_tags=(), only_relative: bool = False, strict_nofollow: bool = False) -> list[tuple]:
    """The links of a document, resolved, without duplicates, in document order."""
    walker = _Walker()
    walker.feed(html)
    walker.close()
    base = join_url(url, _soup(walker.base)) or url if walker.base else url
    found: dict[tuple, tuple] = {}

    def add(tag, attrib, link, inline, linked, kind, value, own_base) -> None:
        if only_relative and ("://" in link or own_base):
            return
        target = join_url(join_url(base, _soup(own_base)) if own_base else base, _soup(link))
        if target and not (linked and strict_nofollow and walker.nofollow and not inline):
            found.setdefault((target, inline, linked, kind), (len(found), tag, attrib, target, inline, linked, kind, value))

    target = refresh_target(refresh) if refresh else None
    if target:
        add("_refresh", None, target, False, True, None, "refresh", None)
    for tag, attrib, text in walker.elements:
        if (not follow_tags or tag in follow_tags) and tag not in ignore_tags:
            for found_link in element_links(Element(tag, attrib, text, css, scripts)):
                add(tag, *found_link)
    return list(found.values())


def _few(batches: Iterator[pa.RecordBatch], rows: int = PAGES) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or less: a batch's pages and links are never all Python objects at once."""
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def html_links(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html", refresh_col: str | None = None, **options) -> DataFrame:
    """One row for each link of each page: the key and FIELDS. Any text is a page: what is no markup is passed over."""
    kind = dict(pages.dtypes)[key]
    names = [key, *(c.split(" ")[0] for c in FIELDS.split(", "))]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches):
            place, rows = [], []
            cells = [c.to_pylist() for c in part.columns[1:]]
            for i, (url, html, *rest) in enumerate(zip(*cells, strict=True)):
                if html is None or url is None:
                    continue
                links = document_links(html, url, rest[0] if rest else None, **options)
                place += [i] * len(links)
                rows += links
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=names)

    return pages.select(key, url_col, html_col, *([refresh_col] if refresh_col else [])).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")


# --- native paths -------------------------------------------------------------------------------------------------


_ANCHOR = r"""(?i)<a(?:\s+[a-z][a-z0-9_:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def anchor_hrefs(html: Column) -> Column:
    """array of the href values of ``a`` elements, in quotes of both kinds or none: the fast path for pages whose links
    are anchors without character references."""
    return F.transform(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def style_texts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))


def script_texts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))


def css_urls(css: Column) -> Column:
    """array<struct<link, link_type>> of url() and @import; an import in url() form is reported once, as css."""
    imports = F.transform(F.regexp_extract_all(css, F.lit(CSS_IMPORT), F.lit(1)), lambda x: F.struct(x.alias("link"), F.lit("css").alias("link_type")))
    rest = F.regexp_replace(css, CSS_IMPORT, "")
    urls = F.transform(F.regexp_extract_all(rest, F.lit(CSS_URL), F.lit(2)), lambda x: F.struct(x.alias("link"), F.lit("media").alias("link_type")))
    return F.filter(F.concat(imports, urls), lambda x: F.length(x["link"]) < 500)


def script_strings(script: Column) -> Column:
    """array of string literals that look like links; JSON escapes are resolved natively."""
    texts = F.transform(F.regexp_extract_all(script, F.lit(JS_STRING), F.lit(2)), lambda x: F.get_json_object(F.concat(F.lit('{"a":"'), x, F.lit('"}')), "$.a"))
    return F.filter(texts, lambda x: x.isNotNull() & L.is_likely_link(x) & ~L.is_unlikely_link(x))


def sitemap_urls(body: Column) -> Column:
    """array of <loc> texts of a sitemap, or of Sitemap lines of robots.txt."""
    locs = F.xpath(F.when(body.contains("<?xml"), body), F.lit("//*[local-name()='loc']/text()"))
    lines = F.regexp_extract_all(F.substring(body, 1, 4096), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return F.when(body.contains("<?xml"), locs).otherwise(lines)


def srcset_urls(value: Column) -> Column:
    return F.transform(F.split(value, ","), lambda x: F.regexp_extract(F.ltrim(x), "^([^ ]*)", 1))


def extra_urls(origins: Column) -> Column:
    """The robots.txt and sitemap of an origin."""
    return F.array(F.concat(origins, F.lit("/robots.txt")), F.concat(origins, F.lit("/sitemap.xml")))


def union_links(*parts: DataFrame) -> DataFrame:
    """The links of several scrapers, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
