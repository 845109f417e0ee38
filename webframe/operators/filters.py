"""Predicates on (URL, record) as native columns, and the verdict over them.

A record is a frontier row joined with its URL's parts; :func:`record_columns` derives the parts natively. Predicates stay
columns, so Catalyst pushes them below joins; the map of results is projected only where it is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.functions import urls as U

SCHEMES = ("http", "https", "ftp")


def record_columns(frontier: DataFrame) -> DataFrame:
    """Adds scheme, hostname, port, path, and the same of parent and root, to canonical URLs."""
    out = frontier
    for prefix, url in (("", "url"), ("parent_", "parent_url"), ("root_", "root_url")):
        out = out.withColumns({prefix + n: f(F.col(url)) for n, f in (("scheme", U.scheme), ("hostname", U.hostname), ("port", U.port), ("path", U.path))})
    return out


def _inline() -> Column:
    return F.coalesce(F.col("inline_level"), F.lit(0))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def scheme_filter(allowed: tuple[str, ...] = SCHEMES) -> Column:
    return F.col("scheme").isin(*allowed)


def https_only() -> Column:
    return F.col("scheme") == "https"


def follow_ftp(follow: bool = False) -> Column:
    return F.lit(follow) | (F.col("scheme") != "ftp") | ~F.coalesce(F.col("parent_scheme").isin("http", "https"), F.lit(False))


def domains(accepted: tuple[str, ...] = (), rejected: tuple[str, ...] = ()) -> Column:
    """A plain suffix test: ``example.com`` also accepts ``notexample.com``."""
    ends = lambda names: _any([F.col("hostname").endswith(n) for n in names])
    return (ends(accepted) if accepted else F.lit(True)) & ~ends(rejected)


def hostnames(accepted: tuple[str, ...] = (), rejected: tuple[str, ...] = ()) -> Column:
    return (F.col("hostname").isin(*accepted) if accepted else F.lit(True)) & (~F.col("hostname").isin(*rejected) if rejected else F.lit(True))


def recursive(enabled: bool = False, page_requisites: bool = False) -> Column:
    return F.when(F.col("level") == 0, True).when(_inline() > 0, F.lit(page_requisites)).otherwise(F.lit(enabled))


def levels(max_depth: int, inline_max_depth: int = 5) -> Column:
    """Depth 0 is unbounded; inline items may be two levels deeper than pages."""
    inline_ok = F.lit(inline_max_depth == 0) | (_inline() <= inline_max_depth)
    return inline_ok & (F.lit(max_depth == 0) | (F.col("level") <= F.lit(max_depth) + F.when(_inline() > 0, 2).otherwise(0)))


def tries(max_tries: int) -> Column:
    return F.lit(max_tries == 0) | (F.col("try_count") < max_tries)


def parent() -> Column:
    """Pages of the root's host stay under the root's directory; inline items and other hosts pass."""
    same = (F.col("hostname") == F.col("root_hostname")) & U.schemes_similar(F.col("scheme"), F.col("root_scheme")) & ((F.col("scheme") != F.col("root_scheme")) | (F.col("port") == F.col("root_port")))
    return F.when(_inline() > 0, True).when(F.coalesce(same, F.lit(False)), U.is_subdir(F.col("root_path"), F.col("path"), trailing_slash=True)).otherwise(True)


def span_hosts(enabled: bool = False, page_requisites: bool = False, linked_pages: bool = False, seed: str = "in_seeds", parent_seed: str = "parent_in_seeds") -> Column:
    """Needs the two columns of :func:`with_seed_flags`."""
    return F.lit(enabled) | F.col(seed) | (F.lit(page_requisites) & (_inline() > 0)) | (F.lit(linked_pages) & F.col(parent_seed))


def with_seed_flags(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """Whether the hosts of URL and parent are among the hosts of the level-0 rows: two equi-joins on distinct hosts."""
    hosts = seeds.select(U.hostname(F.col("url")).alias("h")).distinct()
    own = hosts.select(F.col("h").alias("hostname"), F.lit(True).alias("__own"))
    up = hosts.select(F.col("h").alias("parent_hostname"), F.lit(True).alias("__up"))
    joined = records.join(own, "hostname", "left").join(up, "parent_hostname", "left")
    return joined.withColumns({"in_seeds": F.coalesce("__own", F.lit(False)), "parent_in_seeds": F.coalesce("__up", F.lit(False))}).drop("__own", "__up")


def regex(accepted: str | None = None, rejected: str | None = None) -> Column:
    return (F.col("url").rlike(accepted) if accepted else F.lit(True)) & (~F.col("url").rlike(rejected) if rejected else F.lit(True))


def directories(accepted: tuple[str, ...] = (), rejected: tuple[str, ...] = ()) -> Column:
    """Patterns for the whole path: ``/images`` fits that directory alone, ``/images/*`` what is below."""
    under = lambda names: _any([U.is_subdir(n, F.col("path"), wildcards=True) for n in names])
    return (under(accepted) if accepted else F.lit(True)) & ~under(rejected)


def filenames(accepted: tuple[str, ...] = (), rejected: tuple[str, ...] = ()) -> Column:
    """Shell patterns for the end of the file name; an empty name passes."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    ends = lambda names: _any([name.rlike("(?s)" + U.glob_regex(n) + "$") for n in names])
    return F.when(name == "", True).otherwise((ends(accepted) if accepted else F.lit(True)) & ~ends(rejected))


def host_filter(accept_domains=(), reject_domains=(), accept_hostnames=(), reject_hostnames=()) -> Column:
    return domains(accept_domains, reject_domains) & hostnames(accept_hostnames, reject_hostnames)


def assemble(config: CrawlConfig) -> dict[str, Column]:
    """The predicates that a configuration installs, in order."""
    c = config
    out = {}
    if c.https_only:
        out["HTTPSOnlyFilter"] = https_only()
    else:
        out["SchemeFilter"] = scheme_filter()
    out["RecursiveFilter"] = recursive(c.recursive, c.page_requisites)
    out["FollowFTPFilter"] = follow_ftp(c.follow_ftp)
    if c.no_parent:
        out["ParentFilter"] = parent()
    if c.domains or c.exclude_domains:
        out["BackwardDomainFilter"] = domains(c.domains, c.exclude_domains)
    if c.hostnames or c.exclude_hostnames:
        out["HostnameFilter"] = hostnames(c.hostnames, c.exclude_hostnames)
    if c.tries:
        out["TriesFilter"] = tries(c.tries)
    if c.level and c.recursive or c.page_requisites_level:
        out["LevelFilter"] = levels(c.level, c.page_requisites_level)
    if c.accept_regex or c.reject_regex:
        out["RegexFilter"] = regex(c.accept_regex, c.reject_regex)
    if c.include_directories or c.exclude_directories:
        out["DirectoryFilter"] = directories(c.include_directories, c.exclude_directories)
    if c.accept or c.reject:
        out["BackwardFilenameFilter"] = filenames(c.accept, c.reject)
    out["SpanHostsFilter"] = span_hosts(c.span_hosts, "page-requisites" in c.span_hosts_allow, "linked-pages" in c.span_hosts_allow)
    return out


def all_of(tests: dict[str, Column]) -> Column:
    """The bare verdict, for pushdown."""
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests.values()], F.lit(True))


def verdict(tests: dict[str, Column], is_redirect: Column | bool = False, strong_redirects: bool = True) -> Column:
    """struct(verdict, reason, map, passed, failed). A redirect may pass if hosts alone are against it."""
    results = F.create_map(*[x for n, t in tests.items() for x in (F.lit(n), F.coalesce(t, F.lit(False)))]) if tests else F.lit(None).cast("map<string,boolean>")
    failed = F.map_keys(F.map_filter(results, lambda _, v: ~v))
    passed = F.map_keys(F.map_filter(results, lambda _, v: v))
    if not tests:
        return F.struct(F.lit(True).alias("verdict"), F.lit("nofilters").alias("reason"), results.alias("map"), passed.alias("passed"), failed.alias("failed"))
    only_hosts = (F.size(failed) == 1) & (F.get(failed, F.lit(0)) == "SpanHostsFilter")
    redirect = (is_redirect if isinstance(is_redirect, Column) else F.lit(is_redirect)) & F.lit(strong_redirects) & only_hosts
    return F.struct(
        ((F.size(failed) == 0) | redirect).alias("verdict"),
        F.when(redirect, "redirect").otherwise("filters").alias("reason"),
        results.alias("map"),
        passed.alias("passed"),
        failed.alias("failed"),
    )


def with_hook(decided: Column, accept_url) -> Column:
    """``accept_url(url, verdict, reason, map)`` overrides the verdict; its reason is then ``callback_hook``."""
    says = accept_url(F.col("url"), decided["verdict"], decided["reason"], decided["map"])
    return F.struct(F.coalesce(says, decided["verdict"]).alias("verdict"), F.when(says.isNull(), decided["reason"]).otherwise("callback_hook").alias("reason"), decided["map"].alias("map"))


def referer(url: Column, parent_url: Column) -> Column:
    """No referer from https to http."""
    return F.when(~((U.scheme(parent_url) == "https") & (U.scheme(url) == "http")), parent_url)


def subsequent_request(tests: dict[str, Column], is_redirect: Column | bool, is_virtual: Column, strong_redirects: bool = True) -> Column:
    """Whether a request after an item's first one may go out: the filters' verdict, and always for virtual items."""
    return is_virtual | verdict(tests, is_redirect, strong_redirects)["verdict"]


def generic_request(tests: dict[str, Column]) -> Column:
    """Whether a request of a protocol without robots may go out: the filters alone."""
    return verdict(tests)["verdict"]


def sampled(rows: DataFrame, share: float = 0.75, seed: int = 0, key: str = "url") -> DataFrame:
    """A random share of the rows, by a hash of their key, so that a retried task draws the same ones."""
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int(share * (1 << 20)))


def by_scheme(rows: DataFrame, processors: dict[str, object]) -> DataFrame:
    """Each row through the processor of its scheme, a function of a frame; rows of other schemes are ``skipped``.
    Processors return the columns of ``rows`` and ``outcome``."""
    out = rows.filter(~F.col("scheme").isin(*processors)).withColumn("outcome", F.lit("skipped"))
    for name, f in processors.items():
        out = out.unionByName(f(rows.filter(F.col("scheme") == name)))
    return out
