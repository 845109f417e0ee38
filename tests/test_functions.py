"""Text, names, cookies, seeds, visits, hooks and predicates that few queries reach, by literal cases."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import naming as N
from webframe.functions import text as X
from webframe.operators import archive, cookies, filters, frontier, ftp, hooks, results, robots, stats
from webframe.sources import seeds


def values(spark, cases, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_text(spark):
    assert values(spark, ["ab\x00c\x7fé", ""], X.printable) == ["abc", ""]
    assert values(spark, ["abc", "é", ""], X.is_ascii) == [True, False, True]
    assert values(spark, ["1,234 567", "8"], X.parse_int_grouped) == [1234567, 8]
    assert values(spark, ["x-cONTENT-type", "etag"], X.title_case) == ["X-Content-Type", "Etag"]
    assert values(spark, ["Sun, 06 Nov 1994 08:49:37 GMT", "yesterday"], lambda c: F.date_format(X.http_date(c), "yyyy-MM-dd HH:mm:ss")) == ["1994-11-06 08:49:37", None]
    assert values(spark, [0, 1024, -5, 1 << 31, 1 << 50], X.format_size, "long") == ["0.0 B", "1.0 KiB", "-5.0 B", "2.0 GiB", "1024.0 TiB"]
    assert values(spark, ["text/html; charset=utf-8", "text/html", "x; Charset = \"Latin-1\""], X.charset) == ["utf-8", None, "latin-1"]


def test_bytes(spark):
    data = "é text".encode() * 50
    raw = zlib.compress(data)
    assert values(spark, [gzip.compress(data), data, b"\x1f\x8bbroken", None], X.gunzip, "binary") == [data, data, None, None]
    assert values(spark, [gzip.compress(data)[:-9]], X.gunzip_any, "binary")[0]
    assert values(spark, [raw, raw[2:-4], b"no"], X.inflate, "binary") == [data, data, None]
    assert values(spark, [b"3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n", b"5\r\nab", b"zz\r\n"], X.unchunk, "binary") == [b"abcde", None, None]


@pytest.mark.parametrize("data,html,want", [(b"\xef\xbb\xbfx", False, "utf-8-sig"), ("x".encode("utf-16"), False, "utf-16-le"), (b"abc", False, "utf-8"), ("é".encode(), False, "utf-8"), (b"caf\xe9 \x80 text", False, "cp1252"), (b"caf\xe9 \x81", False, "iso8859-1"), ("é".encode() * 20 + b"\xc3", False, "utf-8"), (b'<meta charset="koi8-r">\xc1', True, "koi8-r"), (b'<meta charset="nonsense">', True, "utf-8"), (b"<?xml version='1' encoding='shift_jis'?>\x83e", True, "shift_jis")])
def test_encodings(data, html, want):
    assert X.detect_encoding(data, html=html) == want


@pytest.mark.parametrize("name,options,want", [
    ("asdf", {}, "asdf"), ("asdf\x00", {}, "asdf%00"), ("asdf/asdf", {}, "asdf%2Fasdf"), (".", {}, "%2E"), ("..", {}, "%2E%2E"), ("asdf:", {"os_type": "windows"}, "asdf%3A"), ("asdf.", {"os_type": "windows"}, "asdf%2E"),
    ("aSDf", {"case": "lower"}, "asdf"), ("aSDf", {"case": "upper"}, "ASDF"), ("á", {}, "%C3%A1"), ("á", {"ascii_only": False}, "á"), ("ábcdefghij123456789012345678901234567890", {"max_length": 20}, "%C3%A1bcdefgf29053e2"),
])
def test_safe_names(name, options, want):
    assert N.safe_name(name, **options) == want


def test_file_names(spark):
    assert values(spark, ["inline; filename=a.txt; x=1", 'attachment; filename="a \\"b\\".txt"', "inline", "x; FileName='q'"], N.content_disposition) == ["a.txt", 'a "b".txt', None, "q"]
    assert values(spark, ["a", "b.HTM", "c.css"], lambda p: N.adjust_extension(p, F.lit(True), F.lit(False))) == ["a.html", "b.HTM", "c.css.html"]
    urls = ["http://e.com:81/a/b.html?x=1", "http://e.com/", "ftp://e.com/d/"]
    assert values(spark, urls, lambda u: N.file_path(u, protocol=True, host=True, cut=1)) == ["./e.com:81/a/b.html?x=1", "./e.com/index.html", "./e.com/d/.listing"]


def test_cookies(spark, tmp_path):
    lines = ["# Netscape HTTP Cookie File", "", ".e.com\tTRUE\t/\tFALSE\t200\ta\t1", "#HttpOnly_e.com\tFALSE\t/p\tTRUE\t0\tb\t2", "e.com\tFALSE\t/\tFALSE\t50\t\tnamed", "broken\tline"]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    read = cookies.read(spark, str(tmp_path / "c.txt"))
    assert sorted((r["domain"], r["path"], r["secure"], r["expires"], r["name"], r["value"]) for r in read.collect()) == [(".e.com", "/", False, 200, "a", "1"), ("e.com", "/", False, 50, "named", None), ("e.com", "/p", True, None, "b", "2")]
    assert sorted(r["value"] for r in cookies.lines(read, now=100).collect()) == [lines[2]]
    assert len(cookies.lines(read, now=100, keep_discard=True, keep_expired=True).collect()) == 3
    assert {r["domain"]: (r["n"], r["length"]) for r in cookies.per_domain(read).collect()} == {".e.com": (1, 2), "e.com": (2, 7)}


def test_seeds_and_frontier_stores(spark, tmp_path):
    (tmp_path / "s.txt").write_text("http://b.com\n\n not a url:// \nc.com/x\n")
    found = seeds.seeds(spark, ["HTTP://A.com", "http://"], str(tmp_path / "s.txt"))
    assert {r["url"] for r in found.collect()} >= {"http://a.com/", "http://b.com/", "http://c.com/x"} and found.select("seq").distinct().count() == found.count()
    (tmp_path / "p.html").write_text("<a href=x>1</a><img src='/y.png'>")
    assert {r["url"] for r in seeds.seeds_from_html(spark, str(tmp_path / "p.html"), "http://e.com/d/").collect()} == {"http://e.com/d/x", "http://e.com/y.png"}
    (tmp_path / "q.html").write_text("<a href=z>1</a>")
    each = seeds.seeds_from_html(spark, str(tmp_path / "*.html")).collect()
    assert [r["url"] for r in sorted(each, key=lambda r: r["seq"])] == [f"file://{tmp_path}/x", "file:///y.png", f"file://{tmp_path}/z"]
    rows = frontier.insert(frontier.empty(spark), spark.createDataFrame([(0, "http://a/"), (1, "http://b/")], "seq long, url string"))
    rows = frontier.update_one(rows, "http://b/", status="done", filename="f")
    path = seeds.save_frontier(rows, str(tmp_path / "f"), 3)
    back = {r["url"]: (r["status"], r["filename"], r["level"]) for r in seeds.load_frontier(spark, path).collect()}
    assert back == {"http://a/": ("todo", None, 0), "http://b/": ("done", "f", 0)}


def test_visits_and_conversations(spark):
    visits = spark.createDataFrame([("u1", "w1", "d1")], "url string, warc_id string, payload_digest string")
    more = spark.createDataFrame([("u1", "w2", "d2"), ("u2", "w4", "d4"), ("u2", "w3", "d3")], "url string, warc_id string, payload_digest string")
    assert sorted(map(tuple, archive.add_visits(visits, more).collect())) == [("u1", "w1", "d1"), ("u2", "w3", "d3")]
    events = spark.createDataFrame([("k", 2, "reply", "220 ok"), ("k", 1, "note", "open"), ("k", 3, "command", "USER x")], "k string, n int, kind string, text string")
    assert archive.control_conversation(events, "k", F.col("n")).first()["block"] == "* open\r\n< 220 ok\r\n> USER x"


def test_listing_children_and_parents(spark):
    entries = spark.createDataFrame([("http://h/", "a", "dir", 0o755), ("http://h/", "b.txt", "file", 0o644), ("http://h/", "c", "other", 0), ("http://h/", "l", "symlink", 0o777)], "parent_url string, name string, type string, perm int")
    found = ftp.children(entries, F.col("parent_url"))
    assert sorted(r["child_url"] for r in found.collect()) == ["http://h/a/", "http://h/b.txt", "http://h/l"]
    assert [r["name"] for r in ftp.children(entries, F.col("parent_url"), "*.t?t").collect()] == ["b.txt"]
    asked = spark.createDataFrame([("http://h/a/",), ("http://h/b.txt",), ("http://h/q",)], "url string")
    assert {r["url"]: (r["entry_type"], r["entry_perm"]) for r in ftp.with_parent_entry(asked, entries).collect()} == {"http://h/a/": ("dir", 0o755), "http://h/b.txt": ("file", 0o644), "http://h/q": (None, None)}


def test_hooks_and_actions(spark):
    class Plugin:
        def handle_response(self, url, code):
            return F.when(code == 500, "retry").otherwise("normal")

        def handle_error(self, url, error):
            return F.lit("finish")

        def wait_time(self, seconds):
            return seconds * 2

    h = hooks.attach(hooks.Hooks(), Plugin())
    rows = spark.createDataFrame([("a", 200, None), ("b", 500, None), ("c", None, "DNSNotFound")], "url string, status_code int, error string")
    found = {r["url"]: (r["action"], r["status"]) for r in hooks.handled(rows, h, F.lit("skipped")).collect()}
    assert found == {"a": ("normal", "skipped"), "b": ("retry", "error"), "c": ("finish", "done")}
    assert rows.select(hooks.wait_seconds(h, F.lit(1.5)).alias("w")).first()["w"] == 3.0 and hooks.exit_code(h, 4) == 4
    with pytest.raises(ValueError):
        h.connect("wait_time", lambda s: s)
    with pytest.raises(ValueError):
        h.connect("no_such_hook", lambda s: s)
    before = hooks.Hooks()
    before.connect("handle_pre_response", lambda url, code: F.when(url == "a", "stop").otherwise("normal"))
    assert [r["action"] for r in hooks.handled(rows, before, F.lit("done")).orderBy("url").collect()] == ["stop", "normal", "normal"]
    assert results.EXIT_CODES["ProtocolError"] == 7


def test_predicates(spark):
    rows = spark.createDataFrame([(1, "ftp", "http", "a.example.com"), (2, "ftp", "ftp", "b.org"), (3, "http", "ftp", "example.com"), (4, "ftp", None, "x.org")], "i int, scheme string, parent_scheme string, hostname string")
    pick = lambda test: {r["i"] for r in rows.filter(test).collect()}
    assert pick(filters.follow_ftp()) == {2, 3, 4} and pick(filters.follow_ftp(True)) == {1, 2, 3, 4}
    assert pick(filters.host_filter(accept_domains=("example.com",), reject_hostnames=("example.com",))) == {1}
    assert values(spark, [200, 404, 503, 301], robots.file_verdict, "int") == ["parse", "allow_all", "error", "allow_all"]
    assert list(filters.assemble(CrawlConfig(https_only=True, no_parent=True, accept=("*.x",)))) == ["HTTPSOnlyFilter", "RecursiveFilter", "FollowFTPFilter", "ParentFilter", "TriesFilter", "LevelFilter", "BackwardFilenameFilter", "SpanHostsFilter"]


def test_link_sets(spark):
    links = spark.createDataFrame([("k", "b", True, False), ("k", "a", True, True), ("k", "a", True, True), ("q", "z", False, True)], "k string, link string, inline boolean, linked boolean")
    assert {r["k"]: (r["inline_links"], r["linked_links"]) for r in stats.link_sets(links, "k").collect()} == {"k": (["a", "b"], ["a"]), "q": ([], ["z"])}


def test_frontier_in_a_sql_store(spark, tmp_path):
    rows = frontier.insert(frontier.empty(spark), spark.createDataFrame([(0, "http://a/"), (1, "http://b/ü")], "seq long, url string"))
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    seeds.save_frontier_jdbc(rows, url, driver=driver)
    back = seeds.load_frontier_jdbc(spark, url, driver=driver)
    assert back.columns == frontier.COLUMNS
    assert sorted((r["seq"], r["url"], r["status"], r["level"], r["filename"]) for r in back.collect()) == [(0, "http://a/", "todo", 0, None), (1, "http://b/ü", "todo", 0, None)]


def test_bodies_go_to_python_by_the_hundred(spark):
    import gzip

    from pyspark.sql import functions as F

    from webframe.functions import text as X

    rows = [(k, gzip.compress(b"x" * k) if k % 3 else None if k % 2 else b"\x1f\x8bbad") for k in range(250)]
    frame = spark.createDataFrame(rows, "k int, b binary").select("k", X.gunzip(F.col("b")).alias("b"))
    assert "ArrowEvalPython" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["b"] and bytes(r["b"]) for r in frame.collect()} == {k: b"x" * k if k % 3 else None for k, _ in rows}
