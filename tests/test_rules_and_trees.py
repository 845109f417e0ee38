"""Rule tables against Python's own matching, robots rules, sitemap trees, table functions, politeness streams."""

import fnmatch
import gzip
import random
from collections import defaultdict

from pyspark.sql import functions as F

from webframe.functions import tables
from webframe.operators import robots, rule_tables, sitemaps, stats
from webframe.streaming import politeness


def test_domain_rules_fit_at_any_character(spark):
    rng = random.Random(1)
    hosts = ["example.com", "notexample.com", "a.b.example.com", "com", "x", *("".join(rng.choice("ab.") for _ in range(rng.randrange(1, 9))).strip(".") or "a" for _ in range(80))]
    urls = spark.createDataFrame([(k, f"http://{h}/p", "clash") for k, h in enumerate(hosts)] + [(900, None, None), (901, "http://example.com/q", "x")], "k int, url string, value string")
    for rules in ([("example.com", True), ("b.example.com", False)], [("b", False), ("a.a", False)], [("b", True), ("ab", False), ("b", True)], []):
        found = {r["k"]: r["domain_ok"] for r in rule_tables.domain_verdicts(urls, spark.createDataFrame(rules, "rule string, accept boolean")).collect()}
        asked = any(a for _, a in rules)
        ok = lambda h: not any(h.endswith(r) for r, a in rules if not a) and (not asked or any(h.endswith(r) for r, a in rules if a))  # noqa: B023, E731
        assert found == {k: ok(h) for k, h in enumerate(hosts)} | {900: ok(""), 901: ok("example.com")}


def test_path_rules_are_shell_patterns(spark):
    rng = random.Random(2)
    paths = ["/", "/images", "/images/a.png", "/img/x(1).html", "/a.b/c", *("/" + "".join(rng.choice("abc/.") for _ in range(rng.randrange(12))) for _ in range(150))]
    urls = spark.createDataFrame([(k, f"http://h{k % 3}.e{p}") for k, p in enumerate(paths)], "k int, url string")
    rules = [("/images/*", True), ("/ab*", True), ("*bc*", True), ("/?b*", True), ("*.png", False), ("/a[ab]*", True), ("/a[!ab]*c", False), ("*a*b*c", False), ("/img/x(1).html", True), ("*", True), ("/a.b/*", False)]
    from webframe.functions import urls as U

    real = {r["k"]: r["p"] for r in urls.select("k", U.path(F.col("url")).alias("p")).collect()}
    for some in (rules, rules[:4], rules[4:5], rules[5:8], [r for r in rules if not r[1]]):
        found = {r["k"]: r["path_ok"] for r in rule_tables.path_verdicts(urls, spark.createDataFrame(some, "rule string, accept boolean")).collect()}
        asked = any(a for _, a in some)
        fits = lambda p, want: any(fnmatch.fnmatchcase(p, r) for r, a in some if a == want)  # noqa: B023, E731
        assert found == {k: not fits(p, False) and (not asked or fits(p, True)) for k, p in real.items()}


def test_many_rules_make_no_pairs_of_all(spark):
    urls = spark.range(2000).select("id", F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".example/d"), F.col("id").cast("string"), F.lit("/x")).alias("url"))
    rules = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example")).alias("rule"), (F.col("id") % 2 == 0).alias("accept"))
    judged = rule_tables.domain_verdicts(urls, rules)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.filter("domain_ok").count() == 1000 and plan.count("Join Cross") == 1  # with one row, whether any rule accepts
    globs = spark.range(20_000).select(F.concat(F.lit("/d"), F.col("id").cast("string"), F.lit("/*")).alias("rule"), (F.col("id") % 4 == 0).alias("accept"))
    assert rule_tables.path_verdicts(urls, globs).filter("path_ok").count() == 500


def test_robots_patterns_plain_and_wild(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.php$\nDisallow: /q?x=\nAllow: /a/*/ok\nDisallow: /end$\nDisallow: /(x\n"
    rules = robots.rules(spark.createDataFrame([("http://e", body)], "origin string, body string"))
    paths = {"/": True, "/a": False, "/ab": False, "/a/b/c": True, "/x.php": False, "/x.php5": True, "/q?x=1": False, "/q": True, "/a/z/ok": True, "/end": False, "/ending": True, "/(x": False, "/robots.txt": True}
    urls = spark.createDataFrame([(f"http://e{p}",) for p in paths], "url string")
    assert {r["url"][8:]: r["robots_ok"] for r in robots.allowed(urls, rules, "webframe").collect()} == paths
    plan = robots.allowed(urls, rules, "webframe")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 25_000


def sitemap(kind, locs):
    tag = "sitemap" if kind == "sitemapindex" else "url"
    return f'<?xml version="1.0"?><{kind}>{"".join(f"<{tag}><loc>{x}</loc></{tag}>" for x in locs)}</{kind}>'.encode()


def test_sitemap_indexes_are_followed_to_their_leaves(spark):
    bodies = [
        ("http://e/robots.txt", b"User-agent: *\nSitemap: http://e/index.xml\nSitemap: http://e/gone.xml\n"), ("http://e/index.xml", gzip.compress(sitemap("sitemapindex", ["http://e/a.xml.gz", "http://e/sub.xml"]))),
        ("http://e/sub.xml", sitemap("sitemapindex", ["http://e/b.xml", "http://e/index.xml", "http://e/sub.xml"])), ("http://e/a.xml.gz", gzip.compress(sitemap("urlset", ["http://e/1", "http://e/2?x=1&amp;y=2"]))),
        ("http://e/b.xml", sitemap("urlset", ["http://e/2?x=1&amp;y=2", "/rel"])), ("http://e/page", b"<html>http://no"),
    ]
    frame = spark.createDataFrame(bodies, "url string, body binary")
    roots = spark.createDataFrame([("http://e/robots.txt",), ("http://e/b.xml",), ("http://e/page",), ("http://e/none",)], "url string")
    found = {tuple(r) for r in sitemaps.follow(roots, frame).select("root", "sitemap", "link").collect()}
    r, b = "http://e/robots.txt", "http://e/b.xml"
    assert found == {(r, "http://e/a.xml.gz", "http://e/1"), (r, "http://e/a.xml.gz", "http://e/2?x=1&y=2"), (r, b, "http://e/2?x=1&y=2"), (r, b, "http://e/rel"), (b, b, "http://e/2?x=1&y=2"), (b, b, "http://e/rel")}


def test_table_functions_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "http://e/d/", "<a href=x>1</a><img src=/i.png>", "a{background:url(b.gif)}", 'f("/s/t.html")'), (2, None, "<a href=y>", None, None), (3, "http://e/", None, "", "")], "id int, url string, html string, css string, js string").createOrReplaceTempView("udtf_pages")
    found = {tuple(r) for r in spark.sql("SELECT id, l.tag, l.link, l.inline FROM udtf_pages, LATERAL html_links(html, url) l").collect()}
    assert found == {(1, "a", "http://e/d/x", False), (1, "img", "http://e/i.png", True)}
    assert [tuple(r) for r in spark.sql("SELECT id, l.link, l.link_type FROM udtf_pages, LATERAL css_links(css, url) l").collect()] == [(1, "http://e/d/b.gif", "media")]
    assert [tuple(r) for r in spark.sql("SELECT id, l.link FROM udtf_pages, LATERAL script_links(js, url) l").collect()] == [(1, "http://e/s/t.html")]


def events(seed=4, n=400):
    rng = random.Random(seed)
    out, t = [], defaultdict(lambda: 1_700_000_000_000_000)
    for _ in range(n):
        host = rng.choice(["a", "a", "a", "b", "c"])
        t[host] += rng.choice([20_000, 90_000, 160_000, 700_000, 6_000_000 if rng.random() < 0.05 else 50_000])
        out.append((host, t[host], rng.choice([0, 0, 100, 5000]), rng.random() < 0.3))
    return out


def test_a_stream_of_shuffled_events_equals_plain_loops(spark, tmp_path):
    rules = politeness.Rules(wait=0.5, waitretry=3, limit=2000.0, hook=lambda s: s * 2)
    rows = events()
    want = []
    for host in "abc":
        fold = politeness.HostFold(rules)
        want += [(host, *fold.event(t, n, f)) for h, t, n, f in sorted(rows) if h == host]
    rng = random.Random(6)
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(8_000_000))
    source, kinds = str(tmp_path / "events"), "host string, ts timestamp, size long, failed boolean"
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        cut = [mixed[i : i + 150] for i in range(0, len(mixed), 150)]
        last = max(r[1] for r in rows)
        for part in (*cut, [("~", last + 60_000_000, 0, False)], [("~", last + 61_000_000, 0, False)]):
            frame = spark.createDataFrame(part, "host string, t long, size long, failed boolean")
            frame.select("host", F.timestamp_micros("t").alias("ts"), "size", "failed").coalesce(1).write.mode("append").parquet(source)
            stream = politeness.polite(spark.readStream.schema(kinds).parquet(source), rules, late="20 seconds")
            # each call goes on from the checkpoint of the one before
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    near = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    found = [near(tuple(r)) for r in spark.read.schema(politeness.OUT).parquet(str(tmp_path / "out")).collect() if r["host"] != "~"]
    assert sorted(found, key=str) == sorted(map(near, want), key=str)


def test_merged_samples_stream_through_their_state(spark):
    rows = events(seed=9) + [(None, 1_700_000_000_000_000 + k * 100_000, 7, False) for k in range(30)]
    feeds = spark.createDataFrame([(h, t, n) for h, t, n, _ in rows], "host string, t long, n long").withColumn("ts", F.timestamp_micros("t")).repartition(5)
    want = []
    for host in ("a", "b", "c", None):
        fold = stats.SampleFold()
        want += [(host, *made) for h, t, n in sorted((r[:3] for r in rows if r[0] == host), key=lambda r: r[1:]) if (made := fold.feed(t, n))]
    found = [tuple(r) for r in stats.merge_samples(feeds, "host", "ts", "n").select("host", "seconds", "n", "stalled").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_politeness_sets_one_timer_for_many_events(spark):
    """A timer for each millisecond once read and wrote all that was held, so hosts took the square of their events."""
    import pandas as pd

    class Held:
        def __init__(self, calls):
            self.rows, self.calls = None, calls

        def exists(self):
            return bool(self.rows)

        def get(self):
            self.calls.append("get")
            return iter(self.rows or []) if not isinstance(self.rows, tuple) else self.rows

        def put(self, rows):
            self.calls.append("put")
            self.rows = list(rows)

        def appendList(self, rows):
            self.calls.append("append")
            self.rows = [*(self.rows or []), *rows]

        def appendValue(self, row):
            self.appendList([row])

        def update(self, row):
            self.rows = tuple(row)

        def clear(self):
            self.rows = None

    class Handle:
        def __init__(self):
            self.timers, self.calls = [], []

        def getListState(self, *_):
            return Held(self.calls)

        getValueState = getListState

        def registerTimer(self, at):
            self.timers.append(at)

    class Time:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    handle, fold = Handle(), politeness.HostFold(politeness.Rules(wait=1))
    it = politeness.Politeness(politeness.Rules(wait=1))
    it.init(handle)
    events = [(k * 5_000, k, k % 3 == 0) for k in range(1, 1001)]
    list(it.handleInputRows(("h",), iter([pd.DataFrame(events[::-1], columns=["t", "n", "failed"])]), Time(0)))
    assert handle.timers == [6] and handle.calls == ["append"]
    want = [("h", *fold.event(*e)) for e in events]
    out = [tuple(r) for f in it.handleExpiredTimer(("h",), Time(2500), Time(6)) for r in f.astype(object).values]
    assert [r[:4] for r in out] == [r[:4] for r in want[:499]] and handle.timers == [6, 2501]
    out = [tuple(r) for f in it.handleExpiredTimer(("h",), Time(9000), Time(2501)) for r in f.astype(object).values]
    assert [r[:4] for r in out] == [r[:4] for r in want[499:]] and len(handle.timers) == 2
