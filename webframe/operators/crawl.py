"""Crawling a snapshot: waves of check-out, fetch (a join), verdict, extraction and insertion, until no URL is left.

Each wave is one plan over the frontier's open rows, whose size doesn't depend on the waves before it. What a wave changes
and adds is the next version of a :class:`frontier_log.FrontierLog`, against whose known URLs new ones are met without an
exchange on the log's side; open rows are cut with a reliable checkpoint. Counters come from observations of what is
written anyway, so the driver sees sums and no job counts rows. A crawl with a folder of its own can be lost at any time:
called again, it goes on behind its last whole wave.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import urls as U
from webframe.operators import filters as P
from webframe.operators import frontier as fr
from webframe.operators import hooks as H
from webframe.operators import results as R
from webframe.operators import robots
from webframe.operators.frontier_log import COMPACT, FrontierLog
from webframe.session import checkpoint_dir, cut, remove


@dataclass
class Crawl:
    """A crawl: the frontier, why it ended, and its counters, as they were after each wave too."""

    frontier: DataFrame
    files: int = 0
    size: int = 0
    exit_code: int = 0
    ended_by: str = "no URLs left"  # or: quota, hook, waves
    waves: int = 0
    history: list[dict] = field(default_factory=list)


def _wanted(wave: DataFrame, fetches: DataFrame, targets: DataFrame, seeds: DataFrame, tests: dict[str, Column], config: CrawlConfig, hooks: H.Hooks, rules: DataFrame | None, failing: DataFrame | None) -> DataFrame:
    """The wave with verdicts, and what fetching gives: ``__code``, ``__error``, ``__size`` and ``final_url``.

    Redirects are followed inside the item: at most ``max_redirect`` hops, and the last URL must pass the tests again,
    for which hosts alone are no obstacle to a strong redirect. Robots' rules hold for the first and the last URL; where
    a host fails to give them, nothing of it is fetched and its items are tried again.
    """
    records = P.with_seed_flags(P.record_columns(wave), seeds)
    judged = records.withColumn("__v", P.verdict(tests))
    accept = hooks.callbacks.get("accept_url")
    judged = judged.withColumn("__v", P.with_hook(F.col("__v"), accept[0])) if accept else judged
    judged = judged.withColumn("__ok", F.col("__v.verdict"))
    met = chased(judged, targets, config.max_redirect).drop("ended")
    moved = met.filter(F.col("n_hops") > 0).select(*wave.columns, F.col("final_url").alias("__to"))
    again = P.with_seed_flags(P.record_columns(moved.withColumn("__from", F.col("url")).withColumn("url", F.coalesce("__to", "url"))), seeds)
    passes = again.select(F.col("__from").alias("url"), P.verdict(tests, True, config.strong_redirects)["verdict"].alias("__again"))
    met = met.join(passes, "url", "left").withColumn("__ok", F.col("__ok") & F.coalesce("__again", F.lit(True)))
    refused = F.lit(False)
    if config.robots and rules is not None:
        for column in ("url", "final_url"):
            met = robots.allowed(met, rules, config.user_agent, column).withColumn("__ok", F.col("__ok") & F.col("robots_ok")).drop("robots_ok")
    if config.robots and failing is not None:
        met = met.join(failing.select(F.col("origin").alias("__f"), F.lit(True).alias("__failing")), U.origin(F.col("final_url")) == F.col("__f"), "left").drop("__f")
        refused = F.coalesce("__failing", F.lit(False))
    resolver = hooks.callbacks.get("resolve_dns")
    gone = resolver[0](U.hostname(F.col("final_url"))).isNull() if resolver else F.lit(False)
    side = fetches.select(F.col("url").alias("__u"), F.col("status_code").alias("__code"), F.col("error").alias("__error"), F.col("size").alias("__size"))
    met = met.join(side, F.col("final_url") == F.col("__u"), "left").drop("__u")
    lost = F.when(refused, "ServerError").when(F.col("final_url").isNull(), "ProtocolError").when(gone | (F.col("__code").isNull() & F.col("__error").isNull()), "DNSNotFound")
    return met.withColumn("__error", F.when(refused, lost).otherwise(F.coalesce("__error", lost))).withColumn("__code", F.when(~refused, F.col("__code")))


#: The counters that a manifest carries.
COUNTERS = {"files": 0, "size": 0, "exit_code": 0, "waves": 0, "todo": 0, "error": 0, "root_todo": 0}


def _opened(rows: DataFrame, counters: dict) -> DataFrame:
    """The open rows, cut, and how many there are."""
    seen = Observation()
    todo = F.col("status") == "todo"
    rows = cut(rows.select(*fr.COLUMNS).observe(seen, F.count_if(todo).alias("todo"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(todo & (F.col("level") == 0)).alias("root_todo")))
    counters.update(seen.get)
    return rows


def run(spark: SparkSession, seeds: DataFrame, edges: DataFrame, fetches: DataFrame, config: CrawlConfig, hooks: H.Hooks | None = None, robots_files: DataFrame | None = None, max_waves: int | None = None, folder: str | None = None, compact: int = COMPACT) -> Crawl:
    """A crawl of the snapshot.

    ``seeds``: seq, url. ``edges``: url, seq, link, inline, link_type (links of every document of the snapshot, resolved).
    ``fetches``: url, status_code, error, and where known size and location (what fetching gives; URLs beyond it are
    unknown hosts). ``robots_files``: origin, body, and where known status_code. All URLs canonical. What filters or robots
    reject is ``skipped``; an error is tried again until the tries filter rejects it. The quota is looked at after each wave.
    A get_urls hook is given the wave's finished documents (url, level, inline_level, root_url) and gives rows like ``edges``.

    A ``folder`` that all executors share keeps the frontier; a crawl whose folder has one goes on with it, and seeds that it
    doesn't know join it. ``max_waves`` ends the crawl after so many waves of this call, and it says so.
    """
    hooks = hooks or H.Hooks()
    for name, kind in (("location", "string"), ("size", "long")):
        if name not in fetches.columns:
            fetches = fetches.withColumn(name, F.lit(None).cast(kind))
    if config.strip_session_id or config.escaped_fragment:
        edges = edges.withColumn("link", U.rewrite(F.col("link"), config.escaped_fragment, config.strip_session_id))
    rules = failing = None
    if config.robots and robots_files is not None:
        files = robots_files if "status_code" in robots_files.columns else robots_files.withColumn("status_code", F.lit(200))
        files = files.withColumn("__verdict", robots.file_verdict(F.col("status_code")))
        rules = cut(robots.rules(files.filter(F.col("__verdict") == "parse")))
        failing = cut(files.filter(F.col("__verdict") == "error").select("origin").distinct())
    tests = P.assemble(config)
    hops = fetches.filter(F.col("status_code").isin(*R.REDIRECT_CODES) & F.col("location").isNotNull()).select("url", "location")
    targets = cut(redirect_targets(hops, config.max_redirect))
    place = folder or f"{checkpoint_dir(spark).rstrip('/')}/frontier-{uuid.uuid4().hex}"
    log = FrontierLog(spark, place)
    counters = COUNTERS | {k: v for k, v in log.manifest.counters.items() if k in COUNTERS}
    new = fr.insert_new(log.known(), seeds)
    log.write(new)
    opened = _opened((fr.release(log.states()).filter(F.col("status").isin("todo", "error")) if log.resumed else fr.empty(spark)).unionByName(log.written().select(*fr.COLUMNS)), counters)
    hooks.notify("queued_url", log.written().select(*fr.COLUMNS))
    log.commit(**counters)
    seed_rows = cut(log.states().filter(F.col("level") == 0).select("url"))
    out = Crawl(opened, history=[])
    while status := "todo" if counters["todo"] else "error" if counters["error"] else None:
        if max_waves is not None and len(out.history) >= max_waves:
            out.ended_by = "waves"
            break
        _, wave = fr.check_out(opened, status)
        hooks.notify("dequeued_url", wave)
        met = _wanted(wave, fetches, targets, seed_rows, tests, config, hooks, rules, failing)
        plain = F.coalesce(R.status_of_error(F.col("__error"), config.retry_connrefused, config.retry_dns_error), R.status_of_code(F.col("__code"), config.content_on_error))
        action = H.action_of(hooks, F.col("url"), F.col("__code"), F.col("__error"))
        end = F.when(~F.col("__ok"), "skipped").otherwise(R.action_status(action, F.when(plain == "redirect", "error").otherwise(plain)))
        kept = [c for c in fr.COLUMNS if c not in ("status", "status_code", "try_count")]
        done = met.select(*kept, end.alias("status"), F.coalesce("__code", "status_code").alias("status_code"), (F.col("try_count") + 1).alias("try_count"), "final_url", F.when(F.col("__ok"), F.col("__error")).alias("error"), F.col("__size"), (F.col("__ok") & (action == "stop")).alias("__stop"))
        seen, finished = Observation(), F.col("status") == "done"
        done = cut(done.observe(seen, F.count_if(finished).alias("files"), F.coalesce(F.sum(F.when(finished, F.col("__size"))), F.lit(0)).alias("size"), F.coalesce(F.max("__stop"), F.lit(False)).alias("stop"), F.min(F.nullif(R.exit_code_of(F.col("error")), F.lit(0))).alias("code")))
        told = seen.get
        counters["files"], counters["size"], counters["waves"] = counters["files"] + told["files"], counters["size"] + told["size"], counters["waves"] + 1
        counters["exit_code"] = min(filter(None, (counters["exit_code"], told["code"])), default=0)
        parents = done.filter(finished).select(F.col("final_url").alias("url"), "level", "inline_level", "root_url")
        found = edges.join(parents, "url")
        more = H.more_urls(parents, hooks)
        if more is not None:
            found = found.unionByName(more.join(parents, "url").select(*found.columns))
        record_only = {k: v for k, v in tests.items() if k in ("RecursiveFilter", "LevelFilter")}
        wanted = fr.first_per(fr.new_rows(fr.child_rows(found)).filter(P.all_of(record_only)), "url", F.col("seq"))
        wanted = wanted.join(log.known(), "url", "left_anti").select(*fr.COLUMNS, F.lit(None).cast("string").alias("error"))
        log.write(done.select(*fr.COLUMNS, "error").unionByName(wanted))
        hooks.notify("queued_url", log.written().filter(F.col("status") == "todo").select(*fr.COLUMNS))
        opened = _opened(opened.filter(F.col("status") != status).unionByName(log.written().filter(F.col("status").isin("todo", "error")).select(*fr.COLUMNS)), counters)
        log.commit(**counters)
        log.compact(compact)
        out.history.append(dict(counters))
        if told["stop"]:
            out.ended_by = "hook"
            break
        if config.quota is not None and counters["size"] >= config.quota and not counters["root_todo"]:
            out.ended_by = "quota"
            break
    out.files, out.size, out.waves = counters["files"], counters["size"], counters["waves"]
    out.frontier = log.states()
    if folder is None:
        out.frontier = cut(out.frontier)
        log.close()
        remove(spark, place)
    out.exit_code = H.exit_code(hooks, counters["exit_code"])
    hooks.notify("finishing_statistics", {"files": out.files, "size": out.size, "exit_code": out.exit_code, "ended_by": out.ended_by})
    return out


def crawl(spark: SparkSession, seeds: DataFrame, edges: DataFrame, fetches: DataFrame, config: CrawlConfig, accept_url=None, **options) -> DataFrame:
    """The final frontier of :func:`run`."""
    hooks = options.pop("hooks", None) or H.Hooks()
    if accept_url:
        hooks.connect("accept_url", accept_url)
    return run(spark, seeds, edges, fetches, config, hooks, **options).frontier


def bfs_levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, level): shortest distance from the seeds, to ``depth``. An anti-join keeps each wave to new nodes."""
    seen = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    last = seen
    for level in range(1, depth + 1):
        nxt = edges.join(last.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        last = cut(nxt.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if last.limit(1).count() == 0:
            break
        seen = seen.unionByName(last)
    return seen


def redirect_targets(hops: DataFrame, max_redirects: int = 20) -> DataFrame:
    """(url, to, n) for each of ``hops`` (url, location): where its chain is after n hops, at its end or beyond the most.

    Pointers are doubled: each of the log2(max_redirects) rounds is one equi-join of the hops with themselves.
    """
    to = hops.groupBy("url").agg(F.min("location").alias("to")).withColumn("n", F.lit(1))
    for _ in range(max_redirects.bit_length()):
        to = cut(to)
        on = to.select(F.col("url").alias("to"), F.col("to").alias("__next"), F.col("n").alias("__more"))
        met = to.join(on, "to", "left")
        if not met.filter(F.col("__next").isNotNull() & (F.col("n") <= max_redirects)).limit(1).count():
            break
        far = F.col("n") > max_redirects  # a chain that is too long already needn't go on
        to = met.select("url", F.when(far, F.col("to")).otherwise(F.coalesce("__next", "to")).alias("to"), (F.col("n") + F.when(far, 0).otherwise(F.coalesce("__more", F.lit(0)))).alias("n"))
    return to


def chased(rows: DataFrame, targets: DataFrame, max_redirects: int = 20) -> DataFrame:
    """``rows`` (url, ...) with final_url, n_hops and ended. Chains of more than the most, and cycles, don't end and have no
    final URL."""
    joined = rows.join(targets.select("url", F.col("to").alias("__to"), F.col("n").alias("__n")), "url", "left")
    ended = F.coalesce(F.col("__n") <= max_redirects, F.lit(True))
    return joined.withColumns({"final_url": F.when(ended, F.coalesce("__to", "url")), "n_hops": F.least(F.coalesce("__n", F.lit(0)), F.lit(max_redirects + 1)), "ended": ended}).drop("__to", "__n")


def redirect_chains(starts: DataFrame, hops: DataFrame, max_redirects: int = 20) -> DataFrame:
    """(url, final_url, n_hops, ended): follows ``hops`` (url, location), unique by URL."""
    return chased(starts.select("url").distinct(), redirect_targets(hops, max_redirects), max_redirects)
