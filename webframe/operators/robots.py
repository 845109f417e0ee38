"""robots.txt: rules as a relation, and verdicts by longest match (RFC 9309)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions import urls as U

MAX_BYTES = 4096


def rules(files: DataFrame, key: str = "origin", body_col: str = "body", max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(key, agent, allow, pattern, ord): one row for each rule and each agent of its group, all in native functions.
    Of a file the first ``max_bytes`` bytes count, or all with None; a file is one row and its lines one short array."""
    body = F.col(body_col).cast("binary")
    text = (body if max_bytes is None else F.substring(body, 1, max_bytes)).cast("string")
    lines = F.split(text, r"\r\n|[\r\n]")
    flat = files.select(key, F.posexplode(lines).alias("ord", "line"))
    text = F.trim(F.regexp_replace("line", "#.*$", ""))  # of a line
    named = flat.select(key, "ord", F.lower(F.trim(F.regexp_extract(text, "^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(text, "^[^:]*:(.*)$", 1)).alias("value")).filter(F.col("name").isin("user-agent", "allow", "disallow"))
    # a group begins at an agent line that follows a rule, or at the first one; one file is one short array
    lists = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "name", "value"))).alias("l"))
    start = F.transform("l", lambda x, i: F.when((x["name"] == "user-agent") & ((i == 0) | (F.get(F.col("l"), i - 1)["name"] != "user-agent")), 1).otherwise(0))
    grouped = lists.select(key, "l", start.alias("s")).select(key, F.posexplode("l").alias("i", "x"), "s").select(key, "x.*", F.aggregate(F.slice("s", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, b: a + b).alias("g"))
    agents = grouped.filter("name = 'user-agent'").select(key, "g", F.lower("value").alias("agent"))
    paths = grouped.filter("name != 'user-agent' AND value != ''").select(key, "g", "ord", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return paths.join(agents, [key, "g"]).select(key, "agent", "allow", "pattern", "ord")


def pattern_regex(pattern: Column) -> Column:
    """``*`` is any text and a final ``$`` the end; other characters are literal."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"[\\.+?^${}()|\[\]]", r"\\$0")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def allowed(urls: DataFrame, rule_rows: DataFrame, agent: str, url_col: str = "url", key: str = "origin") -> DataFrame:
    """``urls`` with ``robots_ok``. The agent's own groups apply, else those of ``*``; the longest pattern wins, and
    of equal ones an allow. An equi-join on the origin; rules are pre-reduced to those of the agent. Plain patterns are
    compared as beginnings; only those with ``*`` or ``$`` are regular expressions, made once for each origin."""
    name = F.lit(agent.lower())
    own = rule_rows.filter((F.col("agent") != "*") & (F.col("agent") != "") & name.contains(F.col("agent")))
    rest = rule_rows.filter(F.col("agent") == "*").join(own.select(key).distinct(), key, "left_anti")
    wild = F.col("pattern").rlike(r"\*|\$$")
    rule = F.struct(F.length("pattern").alias("n"), "allow", F.when(wild, pattern_regex(F.col("pattern"))).otherwise(F.col("pattern")).alias("p"))
    some = lambda test: F.collect_set(F.when(test, rule))
    use = own.unionByName(rest).groupBy(F.col(key).alias("__key")).agg(some(~wild).alias("__plain"), some(wild).alias("__wild"))
    # what is taken from a URL has a column of its own, so that it is computed once
    parts = urls.withColumns({"__origin": U.origin(F.col(url_col)), "__path": U.path(F.col(url_col)), "__query": U.query(F.col(url_col))})
    joined = parts.join(use, F.col("__origin") == F.col("__key"), "left")
    joined = joined.withColumn("__target", F.concat("__path", F.when(F.col("__query") == "", "").otherwise(F.concat(F.lit("?"), "__query"))))
    fits = F.concat(F.filter("__plain", lambda r: F.startswith(F.col("__target"), r["p"])), F.filter("__wild", lambda r: F.rlike(F.col("__target"), r["p"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["allow"])))
    return joined.withColumn("robots_ok", F.coalesce(best["allow"], F.lit(True)) | (F.col("__path") == "/robots.txt")).drop("__origin", "__path", "__query", "__target", "__key", "__plain", "__wild")


def file_verdict(code: Column) -> Column:
    """parse, allow_all, or error (to be tried again)."""
    return F.when(code.between(500, 599), "error").when(code == 200, "parse").otherwise("allow_all")
