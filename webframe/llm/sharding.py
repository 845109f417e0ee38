"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Every step is a built-in DataFrame function. Row numbers follow the order of (id, text digest); only ids, sizes
and digests are shuffled, never texts. The Feistel network works on the pairs (l, r) of Z_a x Z_b with a*b >= n and
a*b - n < a, so that a permuted number is rarely outside the n rows; such a number is permuted again until it is
inside (cycle walking), which keeps the map a permutation of 0..n-1. Shard and slot are then the remainder and the
quotient of the permuted number, so shard counts differ by one at most and slots have no gaps.

Defined results: a null text has no bytes and the checksum of no bytes; null ids come first; rows that are equal in
every used column are interchangeable; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webframe.session import cut

ROUNDS = 6
WALKS = 64


def _round(value: Column, seed: int, k: Column) -> Column:
    return F.xxhash64(F.lit(seed), k, value)


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y))


def _permute_once(x: Column, n: int, seed: int) -> Column:
    a = max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
    b = -(-n // a)
    state = F.struct(_div(x, b).alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(_round(s["r"], seed, k), F.lit(a)), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + F.pmod(_round(s["l"], seed, k), F.lit(b)), F.lit(b)).cast("long")
        even = F.pmod(k, F.lit(2)) == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])
    return F.aggregate(rounds, state, step, lambda s: s["l"] * F.lit(b) + s["r"])


def feistel(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` in a pseudo-random permutation of ``0..n-1``, or a number from n on where WALKS
    steps of the walk don't lead inside: see :func:`permuted`."""
    n = max(1, n)
    walks = F.array(*[F.lit(k) for k in range(WALKS)])
    return F.aggregate(walks, F.lit(-1).cast("long"), lambda y, _: F.when((y >= 0) & (y < n), y).otherwise(_permute_once(F.when(y < 0, x).otherwise(y), n, seed)))


def permuted(df: DataFrame, number: str, n: int, place: str, seed: int = 0) -> DataFrame:
    """Adds ``place`` to the rows of ``df``, whose ``number`` is in ``0..n-1``.

    Fewer than sqrt(n) + 1 numbers lie outside and a walk meets each once at most, so walks end. A walk of more than WALKS
    steps has a chance below sqrt(n)**-WALKS; the rows are looked at for one, and walk on as long as there is any.
    """
    df = df.withColumn(place, feistel(F.col(number), n, seed))
    while df.filter(F.col(place) >= max(1, n)).limit(1).count():
        df = cut(df.withColumn(place, F.when(F.col(place) < n, F.col(place)).otherwise(feistel(F.col(place), n, seed))))
    return df


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Global row numbers from 0 in the given order: range partitions, numbers inside each, and offsets of partitions.

    The sorted rows are checkpointed, so that the counts and the numbers come from the same partitions even if an
    executor is lost. The one-partition window runs over one row for each partition. Partitions are as many as shuffles
    have: few bytes of rows would else be merged into few tasks.
    """
    inner = (1 << 33) - 1
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_pos", F.col("_id").bitwiseAND(F.lit(inner)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_pos")).drop("_id", "_part", "_pos", "_offset")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard (null under the law of rows)."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    numbered = number_rows(rows, ["_key", "size", "text_crc32"])
    n = numbered.count()
    place = permuted(numbered, "row_number", n, "_place", seed)
    return place.select(
        F.col("_key").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_place"), F.lit(shards)).cast("int").alias("shard"),
        _div(F.col("_place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
