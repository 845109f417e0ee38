"""Crawls that are lost and go on, that end when nothing is left, and what their waves cost."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.operators import crawl as C
from webframe.operators import frontier as fr
from webframe.operators import hooks as H
from webframe.operators.frontier_log import FrontierLog

EDGES = "url string, seq long, link string, inline boolean, link_type string"
FETCHES = "url string, status_code int, error string, size long, location string"


def page(n):
    return f"http://h{n % 3}/p{n}"


def snapshot(spark, n=60):
    edges = [(page(k), 10 * k + j, page(t), False, None) for k in range(n) for j, t in enumerate(((k + 1) % n, (2 * k + 3) % n, (5 * k) % n))]
    fetches = [(page(k), 500 if k % 11 == 5 else 302 if k % 13 == 7 else 404 if k % 17 == 3 else 200, "ConnectionRefused" if k % 19 == 4 else None, k, page(k // 2) if k % 13 == 7 else None) for k in range(n)]
    return spark.createDataFrame([(0, page(0)), (1, page(1))], "seq long, url string"), spark.createDataFrame(edges, EDGES).cache(), spark.createDataFrame(fetches, FETCHES).cache()


CONFIG = CrawlConfig(recursive=True, level=30, tries=3, span_hosts=True, robots=False)


def rows(frontier):
    return Counter(tuple(r) for r in frontier.select(*fr.COLUMNS).collect())


@pytest.fixture(scope="module")
def whole(spark):
    done = C.run(spark, *snapshot(spark), CONFIG)
    return done, rows(done.frontier)


def test_a_crawl_ends_when_nothing_is_left(spark, whole):
    done, frontier = whole
    assert done.ended_by == "no URLs left" and not [r for r in frontier if dict(zip(fr.COLUMNS, r, strict=True))["status"] in ("todo", "error", "in_progress")]
    part = C.run(spark, *snapshot(spark), CONFIG, max_waves=2)
    left = part.frontier.filter("status = 'todo'").count()
    assert part.ended_by == "waves" and part.waves == 2 and left == part.history[-1]["todo"] > 0


class Lost(Exception):
    pass


@pytest.mark.parametrize("where", ["before the log", "before the manifest", "after it"])
def test_a_lost_crawl_goes_on_behind_its_last_wave(spark, whole, tmp_path, monkeypatch, where):
    folder = str(tmp_path / "f")
    real_write, real_commit = FrontierLog.write, FrontierLog.commit
    for loss in (2, 4):
        seen = []

        def write(self, made, seen=seen, loss=loss):
            seen.append(1)
            if where == "before the log" and len(seen) == loss:
                raise Lost
            real_write(self, made)

        def commit(self, seen=seen, loss=loss, **counters):
            if where == "before the manifest" and len(seen) == loss:
                raise Lost
            real_commit(self, **counters)
            if where == "after it" and len(seen) == loss:
                raise Lost

        monkeypatch.setattr(FrontierLog, "write", write)
        monkeypatch.setattr(FrontierLog, "commit", commit)
        with pytest.raises(Lost):
            C.run(spark, *snapshot(spark), CONFIG, folder=folder, compact=3)
    monkeypatch.undo()
    done = C.run(spark, *snapshot(spark), CONFIG, folder=folder, compact=3)
    assert rows(done.frontier) == whole[1]
    assert (done.files, done.size, done.exit_code, done.waves) == (whole[0].files, whole[0].size, whole[0].exit_code, whole[0].waves)
    again = C.run(spark, *snapshot(spark), CONFIG, folder=folder)
    assert rows(again.frontier) == whole[1] and again.history == [] and again.ended_by == "no URLs left"


def test_new_seeds_join_a_frontier(spark, tmp_path):
    seeds, edges, fetches = snapshot(spark)
    config, folder = CrawlConfig(recursive=True, level=1, robots=False), str(tmp_path / "f")
    C.run(spark, seeds, edges, fetches, config, folder=folder)
    done = C.run(spark, spark.createDataFrame([(0, page(0)), (50, page(50))], "seq long, url string"), edges, fetches, config, folder=folder)
    levels = {r["url"]: r["level"] for r in done.frontier.collect()}
    assert levels[page(50)] == 0 == levels[page(1)] and levels[page(51)] == 1


def test_a_wave_costs_the_same_whatever_its_number(spark, tmp_path):
    """A path of pages, one in each wave: neither jobs nor the plan grow, and known URLs are met without an exchange."""
    n = 9
    edges = spark.createDataFrame([(page(k), k, page(k + 1), False, None) for k in range(n)], EDGES)
    fetches = spark.createDataFrame([(page(k), 200, None, 1, None) for k in range(n + 1)], FETCHES)
    seeds = spark.createDataFrame([(0, page(0))], "seq long, url string")
    tracker, jobs, plans = spark.sparkContext.statusTracker(), [], []
    hooks = H.Hooks()

    def dequeued(wave):
        spark.sparkContext.setJobGroup(f"wave-{len(jobs)}", "")
        jobs.append(len(tracker.getJobIdsForGroup(f"wave-{len(jobs) - 1}")) if jobs else 0)
        plans.append(len(wave._jdf.queryExecution().optimizedPlan().toString()))

    hooks.connect("dequeued_url", dequeued)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = C.run(spark, seeds, edges, fetches, CONFIG, hooks, folder=str(tmp_path / "f"), compact=100)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert done.waves == n + 1 and len(set(plans[1:])) == 1 and max(jobs[2:]) <= min(jobs[2:]) + 1 and max(jobs) < 30
        log = FrontierLog(spark, str(tmp_path / "f"))
        met = seeds.join(log.known(), "url", "left_anti")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
        assert "Exchange" not in log.states()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_robots_files_that_fail(spark):
    seeds, edges, fetches = snapshot(spark)
    files = spark.createDataFrame([("http://h0", None, 503), ("http://h1", "User-agent: *\nDisallow: /p1\n", 200), ("http://h2", "User-agent: *\nDisallow: /\n", 404)], "origin string, body string, status_code int")
    seeds = seeds.union(spark.createDataFrame([(2, page(2))], seeds.schema))
    done = C.run(spark, seeds, edges, fetches, CrawlConfig(recursive=True, level=3, tries=2, span_hosts=True), robots_files=files)
    found = {r["url"]: (r["status"], r["try_count"]) for r in done.frontier.collect()}
    assert all(v == ("skipped", 3) for u, v in found.items() if u.startswith("http://h0/")) and done.exit_code == 8
    assert all(v == ("skipped", 1) for u, v in found.items() if u.startswith("http://h1/p1"))
    assert any(v[0] == "done" for u, v in found.items() if u.startswith("http://h2/"))


def test_children_of_a_hook(spark):
    seeds, edges, fetches = snapshot(spark)
    hooks = H.Hooks()
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")

    def get_urls(pages):
        to = number(F.col("url")) + 7
        return pages.select("url", to.alias("seq"), F.concat(F.lit("http://h"), (to % 3).cast("string"), F.lit("/p"), to.cast("string")).alias("link"), F.lit(False).alias("inline"), F.lit(None).cast("string").alias("link_type"))

    hooks.connect("get_urls", get_urls)
    fine = fetches.withColumns({"status_code": F.lit(200), "error": F.lit(None).cast("string"), "location": F.lit(None).cast("string")})
    done = C.run(spark, seeds.filter("seq = 0"), edges.limit(0), fine, CrawlConfig(recursive=True, level=30, span_hosts=True, robots=False), hooks)
    assert {r["url"] for r in done.frontier.filter("status = 'done'").collect()} == {page(k) for k in range(0, 60, 7)}


def test_nothing_is_left_of_a_crawl_without_a_folder(spark, tmp_path):
    from webframe.session import checkpoint_dir

    before = [n for n in os.listdir(checkpoint_dir(spark)) if n.startswith("frontier-")]
    C.run(spark, *snapshot(spark), CrawlConfig(recursive=True, level=1, robots=False))
    assert [n for n in os.listdir(checkpoint_dir(spark)) if n.startswith("frontier-")] == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("frontier_") and "lost" in t.name]
