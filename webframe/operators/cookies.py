"""Cookie files (seven tab-separated columns) and acceptance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LENGTH, MAX_PER_DOMAIN = 4100, 50
HEADER = "# Netscape HTTP Cookie File"


def parse(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """domain, domain_specified, path, secure, expires, discard, name, value of each line; others are skipped."""
    line = F.regexp_replace(F.col(line_col), r"^#HttpOnly_", "")
    cells = F.split(F.regexp_replace(line, r"\r?\n$", ""), "\t", -1)
    rows = lines.withColumn("__c", cells).filter(~F.trim(line).rlike(r"^($|#|\$)") & (F.size("__c") == 7))
    c = lambda i: F.get("__c", F.lit(i))
    session = c(4).isin("", "0")
    swapped = c(5) == ""
    return rows.select(
        c(0).alias("domain"), (c(1) == "TRUE").alias("domain_specified"), c(2).alias("path"), (c(3) == "TRUE").alias("secure"), F.when(~session, c(4).cast("long")).alias("expires"), session.alias("discard"),
        F.when(swapped, c(6)).otherwise(c(5)).alias("name"), F.when(~swapped, c(6)).alias("value"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def lines(cookies: DataFrame, now: int, keep_discard: bool = False, keep_expired: bool = False) -> DataFrame:
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    rows = cookies.filter((F.lit(keep_discard) | ~F.col("discard")) & (F.lit(keep_expired) | F.col("expires").isNull() | (F.col("expires") > now)))
    named = F.col("value").isNotNull()
    cells = ["domain", flag(F.col("domain").startswith(".")), "path", flag(F.col("secure")), F.coalesce(F.col("expires").cast("string"), F.lit("")), F.when(named, F.col("name")).otherwise(""), F.when(named, F.col("value")).otherwise(F.col("name"))]
    return rows.select(F.concat_ws("\t", *cells).alias("value"))


def accepted(offers: DataFrame, *order: Column) -> DataFrame:
    """``offers`` (domain, name, value) with ``ok``: ASCII, short enough together with the domain's cookies before it, and
    at most 50 names for a domain; a known name may be set again. Windows are by domain, over distinct names."""
    ascii_only = F.concat("name", F.coalesce("value", F.lit(""))).rlike(r"^[\x00-\x7F]*$")
    w = Window.partitionBy("domain").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("domain", "name").orderBy(*order)) == 1
    rows = offers.withColumn("__new", first.cast("int"))
    size = F.length("name") + F.length(F.coalesce("value", F.lit("")))
    return rows.withColumn("ok", ascii_only & (size < MAX_LENGTH) & ((F.sum("__new").over(w) <= MAX_PER_DOMAIN) | (F.col("__new") == 0))).drop("__new")


def per_domain(cookies: DataFrame) -> DataFrame:
    return cookies.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.length("name") + F.length(F.coalesce("value", F.lit("")))).alias("length"))
