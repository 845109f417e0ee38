"""Links of documents by literal cases: each rule of elements and attributes, bases, tags, scripts, style sheets."""

import pytest
from pyspark.sql import functions as F

from webframe.functions import links as L
from webframe.operators import extract as E

URL = "http://e.com/d/i.html"


def found(html, **options):
    """(tag, attrib, link, inline, linked, link type) without the order"""
    return {(t, a, link.removeprefix("http://e.com/d/"), i, p, k) for _, t, a, link, i, p, k, _ in E.document_links(html, URL, **options)}


CASES = [
    ('<a href="x.html">', ("a", "href", "x.html", False, True, "html")), ("<img src=x.png>", ("img", "src", "x.png", True, False, "media")), ("<iframe src=f>", ("iframe", "src", "f", True, True, None)),
    ("<embed src=m.swf>", ("embed", "src", "m.swf", True, True, "media")), ("<form action=go>", ("form", "action", "go", False, True, None)), ("<q cite=who>", ("q", "cite", "who", True, False, None)),
    ("<div href=odd>", ("div", "href", "odd", False, True, None)), ("<body background=b.gif>", ("body", "background", "b.gif", True, False, "media")),
    ('<link rel="stylesheet" href=s>', ("link", "href", "s", True, False, "css")), ('<link rel="shortcut icon" href=i>', ("link", "href", "i", True, False, "media")), ("<link rel=next href=n>", ("link", "href", "n", False, True, None)),
    ('<meta http-equiv="Refresh" content="3; URL=\'r.html\'">', ("meta", "http-equiv", "r.html", False, True, None)), ('<meta property="og:image" content="o.png">', ("meta", "property", "o.png", False, True, "media")),
    ('<meta property="twitter:player" content="p">', ("meta", "property", "p", False, True, None)), ("<param valuetype=ref value=v.mp3>", ("param", "value", "v.mp3", True, False, "media")),
    ("<style>a{background:url(b.png)}</style>", ("style", None, "b.png", True, False, "media")), ("<style>@import 'c.css';</style>", ("style", None, "c.css", True, False, "css")),
    ('<p style="background:url(\'b.png\')">', ("p", "style", "b.png", True, False, "media")), ("<script src=s.js></script>", ("script", "src", "s.js", True, False, "javascript")),
    ('<script>var a="img/x.png";</script>', ("script", None, "img/x.png", True, False, "media")), ('<script>go("../p.html")</script>', ("script", None, "http://e.com/p.html", False, True, "html")),
    ("<p onclick=\"f('y.html')\">", ("p", "onclick", "y.html", False, True, "html")), ("<a href=\"javascript:f('z.php/')\">", ("a", "href", "z.php/", False, True, None)),
    ('<p data-x="w.jpg">', ("p", "data-x", "w.jpg", True, False, "media")), ("<link>http://e.com/d/t.html</link>", ("link", None, "t.html", False, True, "html")), ("<url>u/</url>", ("url", None, "u/", False, True, None)),
    ('<a href="x\n  y.html\t">', ("a", "href", "xy.html", False, True, "html")), ("<IMG SRC=&amp;.png>", ("img", "src", "&.png", True, False, "media")),
]


@pytest.mark.parametrize("html,want", CASES)
def test_one_link(html, want):
    assert found(html) == {want}


def test_nothing_to_follow():
    for html in ("<meta property=og:title content=x>", "<meta http-equiv=refresh content=5>", "<param value=x.mp3>", '<script>var a="b c";</script>', "<p data-x=word>", "", "<a name=x>", "text"):
        assert not found(html)


def test_plugins_and_sets():
    assert found('<object codebase="c/" data="d.swf" archive="a.jar b.zip"></object>') == {("object", "codebase", "c/", True, False, None), ("object", "data", "c/d.swf", True, False, "media"), ("object", "archive", "c/a.jar", True, False, None), ("object", "archive", "c/b.zip", True, False, None)}
    assert {x[2] for x in found('<img srcset="a.png 1x, b.png 2x">')} == {"a.png", "b.png"}


def test_options():
    html = '<base href="http://b.com/"><meta name=robots content="noindex,NOFOLLOW"><a href=x>1</a><a href="http://o.com/">2</a><img src=i.png><script>var a="run.js"</script>'
    assert {x[2] for x in found(html)} == {"http://b.com/x", "http://o.com/", "http://b.com/i.png", "http://b.com/run.js", "http://b.com/"}
    assert {x[2] for x in found(html, strict_nofollow=True)} == {"http://b.com/i.png", "http://b.com/run.js"}
    assert {x[2] for x in found(html, follow_tags=("a",))} == {"http://b.com/x", "http://o.com/"}
    assert {x[2] for x in found(html, ignore_tags=("a", "base"))} == {"http://b.com/i.png", "http://b.com/run.js"}
    assert "http://o.com/" not in {x[2] for x in found(html, only_relative=True)}
    assert not {x for x in found(html, scripts=False) if x[0] == "script"}
    assert [x[3] for x in E.document_links("", URL, "3; url=later.html")] == ["http://e.com/d/later.html"]


def test_pages_as_a_frame(spark):
    pages = spark.createDataFrame([(1, URL, CASES[0][0] + CASES[1][0]), (2, URL, None), (3, None, "<a href=x>"), (4, URL, "<<<a href=x\0")], "page_id long, url string, html string")
    rows = E.html_links(pages).filter("page_id = 1").collect()
    assert [(r["ordinal"], r["link"], r["inline"]) for r in rows] == [(0, "http://e.com/d/x.html", False), (1, "http://e.com/d/x.png", True)]
    docs = spark.createDataFrame([("a{b:url( \"x.png\" )} @import url(y.css); @import 'z.css';", 'f("/a/b.js"); g("word"); h("http:\\/\\/x.com\\/y");', "x.png 1x, y.png 2x")], "css string, js string, srcset string")
    r = docs.select(E.css_urls(F.col("css")).alias("css"), E.script_strings(F.col("js")).alias("js"), E.srcset_urls(F.col("srcset")).alias("set")).first()
    assert sorted((x["link"], x["link_type"]) for x in r["css"]) == [("x.png", "media"), ("y.css", "css"), ("z.css", "css")]
    assert r["js"] == ["/a/b.js", "http://x.com/y"] and r["set"] == ["x.png", "y.png"]


LIKELY = ["http://example.com", "http://example.com/", "/blah", "blah.html", "../x", "folder/", "x.PNG", "a.b.css"]
UNLIKELY = ["", "/", "//", "a,", ";b", "x.", "f(x)", "a[b]", "{x}", "<a>", ".5", "text/css", "div", "div.x", "a//b", "example.com/x", "$x", "a|b"]


def test_what_looks_like_a_link(spark):
    assert all(L.likely_link(x) for x in LIKELY) and all(L.unlikely_link(x) for x in UNLIKELY)
    assert not any(L.likely_link(x) for x in ("blah", "1.23", "site.com", "x.unknownext")) and not any(L.unlikely_link(x) for x in ("a.html", "//h/x", "http://a//b", "../x", "./x", "img.html", "x/y.js"))
    texts = [*LIKELY, *UNLIKELY, "blah", "1.23", "site.com", "a.html", "//h/x", "http://a//b", "./x", "img.html", "a?b=c.js", "x.js?y=1.2"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", L.is_likely_link(F.col("x")).alias("l"), L.is_unlikely_link(F.col("x")).alias("u")).collect()
    assert {r["x"]: (r["l"], r["u"]) for r in rows} == {x: (L.likely_link(x), L.unlikely_link(x)) for x in texts}


def test_any_text_is_a_page():
    """Cut and scrambled pages, marked sections and broken markup among them, never stop reading."""
    import random

    rng = random.Random(12)
    page = '<!DOCTYPE html><![if !IE]><![CDATA[x]]><html><base href="/b/"><a href="one">1</a><![foo[ <a href="two"> ]]><!-- c --><?php x ?><style>a{background:url(i.png)}</style><script>f("/s.js")</script><p <a href=\'three\' ><meta http-equiv=refresh content="0;url=r"></p></>&#x;&amp<![ x'
    for k in range(1000):
        a, b = sorted(rng.randrange(len(page) + 1) for _ in range(2))
        text = page[:a] if k % 3 == 0 else page[a:b] if k % 3 == 1 else "".join(rng.choice((page[i : i + 4], "<![", "]]>", "<!", "<", ">")) for i in range(a, b, 4))
        E.document_links(text, "http://h/")
    links = [x[3] for x in E.document_links(page, "http://h/")]
    assert {"http://h/b/one", "http://h/b/three", "http://h/b/i.png"} <= set(links)
    assert [x[3] for x in E.document_links("<![foo[<a href=a></a><![ x><a href=b>", "http://h/")] == ["http://h/b"]


def test_pages_become_objects_by_few(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["k"])
    parts = list(E._few(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert max(p.num_rows for p in parts) <= E.PAGES and [k for p in parts for k in p.column(0).to_pylist()] == [*range(1000), 0]
    pages = spark.createDataFrame([(k, "http://a.example/", f"<a href=p{k}>x</a><a href=q{k}>x</a>" if k % 3 else None) for k in range(300)], "page_id int, url string, html string").coalesce(1)
    found = {(r["page_id"], r["link"]) for r in E.html_links(pages).collect()}
    assert found == {(k, f"http://a.example/{x}{k}") for k in range(300) if k % 3 for x in "pq"}
