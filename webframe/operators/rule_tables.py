"""Filter rules as tables, of any number: domain suffixes and path patterns that meet URLs in equi-joins.

Rules are rows (rule, accept). A URL passes if no rejecting rule fits it and, where there are accepting rules, one of them
does. Distinct hosts and paths are judged once, and the verdicts joined back, so a hot host costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.functions import urls as U

#: characters of the literal text by which a pattern without a literal begin is looked up
GRAM = 3


def _verdict(rules: DataFrame, hits: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """(value, name) of ``values`` (value) by ``hits`` (value, accept)."""
    kinds = hits.groupBy("value").agg(F.max("accept").alias("__in"), F.max(~F.col("accept")).alias("__out"))
    asked = rules.agg(F.coalesce(F.max("accept"), F.lit(False)).alias("__asked"))  # one row
    met = values.join(kinds, "value", "left").crossJoin(F.broadcast(asked))
    return met.select("value", (~F.coalesce("__out", F.lit(False)) & (~F.col("__asked") | F.coalesce("__in", F.lit(False)))).alias(name))


def _joined(rows: DataFrame, value: Column, judged: DataFrame, name: str) -> DataFrame:
    held = judged.select(F.col("value").alias("__v"), name)
    return rows.withColumn("__key", F.coalesce(value, F.lit(""))).join(held, F.col("__key") == F.col("__v")).drop("__key", "__v")


def domain_verdicts(rows: DataFrame, rules: DataFrame, url_col: str = "url", name: str = "domain_ok") -> DataFrame:
    """``rows`` with whether their hosts pass ``rules`` (rule, accept): a host fits a rule if it ends with it, at any
    character. Each distinct host gives its ends, and these meet the rules."""
    host = F.coalesce(U.hostname(F.col(url_col)), F.lit(""))
    hosts = rows.select(host.alias("value")).distinct()
    n = F.length("value")
    ends = hosts.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr("value", i))).alias("rule"))
    hits = ends.join(rules.select("rule", "accept").distinct(), "rule").select("value", "accept")
    return _joined(rows, host, _verdict(rules, hits, hosts, name), name)


def _anchored(rules: DataFrame) -> DataFrame:
    """Rules with the literal text before the first wildcard, and the longest literal piece of any place."""
    literals = F.split("rule", r"\*|\?|\[[^\]]*\]")
    return rules.withColumns({"__begin": F.get(literals, F.lit(0)), "__piece": F.aggregate(literals, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))})


def glob_expression(rule: Column) -> Column:
    """The regular expression of a shell pattern for a whole text: ``*`` any text, ``?`` one character, ``[...]`` one of them."""
    literal = F.regexp_replace(rule, r"[\\.+^${}()|]", r"\\$0")
    classes = F.regexp_replace(literal, r"\[!", "[^")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(classes, r"\*", ".*"), r"(?<!\\)\?", "."), F.lit("$"))


def path_verdicts(rows: DataFrame, rules: DataFrame, url_col: str = "url", name: str = "path_ok") -> DataFrame:
    """``rows`` with whether their paths pass ``rules`` (rule, accept), shell patterns for a whole path.

    A pattern is met through literal text that its paths must hold: its begin, if that has GRAM characters, among the
    beginnings of distinct paths of the lengths that rules have; else a gram of its longest literal piece among the paths'
    grams; patterns with less literal text (there are few different ones) are tried on each distinct path. The pattern
    itself decides.
    """
    path = F.coalesce(U.path(F.col(url_col)), F.lit(""))
    paths = rows.select(path.alias("value")).distinct()
    table = _anchored(rules.select("rule", "accept").distinct())
    by_begin = F.length("__begin") >= GRAM
    begins = table.filter(by_begin).withColumn("anchor", F.col("__begin"))
    pieces = table.filter(~by_begin & (F.length("__piece") >= GRAM)).withColumn("anchor", F.substr("__piece", F.lit(1), F.lit(GRAM)))
    rest = table.filter(~by_begin & (F.length("__piece") < GRAM)).withColumn("anchor", F.lit(""))
    lengths = begins.agg(F.collect_set(F.length("anchor")).alias("lengths"))  # one row, as many numbers as a path has characters at most
    heads = paths.crossJoin(F.broadcast(lengths)).select("value", F.explode(F.filter("lengths", lambda k: k <= F.length("value"))).alias("k")).select("value", F.substr("value", F.lit(1), F.col("k")).alias("anchor"))
    size = F.length("value") - GRAM + 1
    grams = paths.filter(size > 0).select("value", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substr("value", i, F.lit(GRAM))))).alias("anchor"))
    met = heads.join(begins, "anchor").unionByName(grams.join(pieces, "anchor")).unionByName(paths.withColumn("anchor", F.lit("")).join(rest, "anchor"))
    hits = met.filter(F.rlike(F.col("value"), glob_expression(F.col("rule")))).select("value", "accept")
    return _joined(rows, path, _verdict(rules, hits, paths, name), name)
