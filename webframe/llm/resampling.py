"""Importance resampling towards a target distribution of hashed word n-grams, by a vectorised byte automaton.

A lookup table classifies the bytes of Arrow's UTF-8 buffers: a word byte becomes its lower-cased self, any other a blank.
Words begin and end where the classes differ. A feature is a run of one to ORDER consecutive words joined by one space,
and its bucket is the CRC-32 of its bytes modulo the number of buckets. CRC registers of all starts advance together, one
byte of each word in a step through the polynomial's table; a longer feature goes on from the register of the shorter one.
Words are taken in the order of their lengths, so the starts still running are a prefix of the arrays; the last few very
long words are finished one by one.

Two passes over the documents: the first adds up counts for each bucket, of which the driver gets one row for each bucket
and side, the second scores every document by the table of gains. Only (id, numbers) are sorted, in ranges, for the draw.

Defined results: a null text has no words; without features the weight is 0; a null id is hashed as the empty text and
comes last among equal scores; repeated rows are each a row of their own; extra columns are ignored by :func:`resample`
and carried by :func:`drawn`; empty tables give an empty result, and an empty target counts nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webframe.llm.words import utf8
from webframe.session import cut

BUCKETS, ORDER, MIN_WORDS, SHARE, SEED = 10_000, 3, 20, (5, 100), 42
PIECE_BYTES = 1 << 20
#: starts left in a step below which each is finished by itself; both ways give the same registers
FEW = 24
_BLANK = 0x20


def _byte_classes() -> np.ndarray:
    """Digits, letters and all bytes from 0x80 on are word bytes; A-Z are lowered and the rest is blank."""
    c = np.full(256, _BLANK, np.uint8)
    for first, last in (("0", "9"), ("a", "z")):
        c[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    c[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    c[0x80:] = np.arange(0x80, 0x100)
    return c


def _crc_table() -> np.ndarray:
    """The reflected CRC-32 of every byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CLASS, TABLE = _byte_classes(), _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def _step(register: np.ndarray, byte) -> np.ndarray:
    return TABLE[(register ^ byte).astype(np.uint8)] ^ (register >> np.uint32(8))


def _advance(register: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers after ``length`` bytes from ``start`` on; lengths descend."""
    register, at, ascending = register.copy(), start.copy(), -length
    k, n = 0, len(start)
    while n:
        if n <= FEW:
            for i in range(n):
                rest = data[at[i] : start[i] + length[i]].tobytes()
                register[i] = zlib.crc32(rest, int(register[i] ^ _ALL)) ^ 0xFFFFFFFF
            break
        register[:n] = _step(register[:n], data[at[:n]])
        at[:n] += 1
        k += 1
        n = int(np.searchsorted(ascending, -k, "left"))
    return register


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classified bytes, word starts, word ends, words before each value) of values end to end."""
    data = CLASS[data]
    word = data != _BLANK
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return data, starts, ends, np.searchsorted(starts, cuts)


def features(column: pa.Array | pa.ChunkedArray, buckets: int = BUCKETS, order: int = ORDER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, words of each value, bucket of each feature, owner of each feature counted from ``from``), for about
    PIECE_BYTES of values at a time; a longer value is a piece of its own."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        piece, starts, ends, before = _words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        count = np.diff(before)
        owner = np.repeat(np.arange(to - at), count)
        length = ends - starts
        by_length = np.argsort(-length, kind="stable")
        found, owners = [], []
        register = np.full(len(starts), _ALL, np.uint32)  # of the feature that began k words earlier, at its last word
        for k in range(order):
            last = by_length[by_length >= k]
            last = last[owner[last - k] == owner[last]]
            begun = register[last - 1] if k else register[last]
            begun = _step(begun, np.uint32(_BLANK)) if k else begun
            register = np.zeros(len(starts), np.uint32)
            register[last] = _advance(begun, piece, starts[last], length[last])
            found.append((register[last] ^ _ALL) % np.uint32(buckets))
            owners.append(owner[last])
        yield at, to, count, np.concatenate(found).astype(np.int64), np.concatenate(owners)
        at = to


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall on each bucket; a task gives one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 ln(p/q)), p and q its smoothed shares in the target and in the documents. The driver gets
    ``buckets`` rows of each side at most."""
    both = bucket_counts(docs, text_col, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, target_col, buckets).withColumn("side", F.lit(1)))
    n = [[0] * buckets, [0] * buckets]
    for r in both.collect():
        n[r["side"]][r["bucket"]] = r["n"]
    total = [sum(x) for x in n]
    ratio = lambda s, t: float((t + 1) * (total[0] + buckets)) / float((s + 1) * (total[1] + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(*n, strict=True)], np.int64)


def _luck(own: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel number that the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, keep: list[str] | None = None, names: tuple[str, str, str, str] = ("n_words", "n_features", "weight", "score")) -> DataFrame:
    """The columns ``keep`` (all, unless told) with words, features, weight and score; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket
    columns = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kinds = dict(docs.dtypes)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            texts = batch.column(len(columns))
            words, made, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, b, count, bucket, owner in features(texts, len(table)):
                words[a:b] = count
                made[a:b] = np.bincount(owner, minlength=b - a)
                weight[a:b] = np.bincount(owner, weights=table[bucket], minlength=b - a).astype(np.int64)  # whole numbers under 2**53
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words), pa.array(made), pa.array(weight)], names=[*batch.schema.names[:-1], "w", "f", "g"])

    schema = "".join(f"c{i} {kinds[c]}, " for i, c in enumerate(columns)) + "w long, f long, g long"
    own = F.col(f"c{columns.index(id_col)}")
    return inner.mapInArrow(run, schema).withColumn("s", F.col("g") + _luck(own, seed)).toDF(*columns, *names)


def ranked(rows: DataFrame, id_col: str, min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, rank: str = "rank") -> DataFrame:
    """``rows`` (id_col, n_words, score and others) with the rank of those that are drawn: of all with ``min_words`` words or
    more the given share with the highest scores, ties to the smaller id. Rows are sorted in ranges and numbered by the
    counts of the partitions before them, so no task gets them all; their own number parts rows that are equal."""
    spark: SparkSession = rows.sparkSession
    rows = cut(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = F.col("n_words") >= min_words
    keys = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("__own")]
    placed = rows.filter(fit).withColumn("__own", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__own")
    placed = cut(placed).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one for each partition
    n = sum(sizes.values()) * share[0] // share[1]
    before, seen = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(seen)
        seen += sizes.get(p, 0)
    number = F.get(F.lit(before or [0]), part.cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = placed.withColumn(rank, number.cast("long")).withColumn(rank, F.when(F.col(rank) <= n, F.col(rank))).drop("__at")
    return numbered.unionByName(rows.filter(~fit).withColumn(rank, F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every document; the rank of those not drawn is null."""
    gain = gains(docs, target, text_col, target_col, buckets)
    return ranked(weighed(docs, gain, text_col, id_col, seed, [id_col]), id_col, min_words, share)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with all their columns: whole rows are filtered by the last drawn score and id, so
    texts cross no exchange. Rows that are equal to the last one in both stay with it."""
    gain = gains(docs, target, text_col, target_col, buckets)
    last = ranked(weighed(docs, gain, text_col, id_col, seed, [id_col]), id_col, min_words, share).filter(F.col("rank").isNotNull()).orderBy(F.desc("rank")).limit(1).collect()
    names = tuple(_free(docs, x) for x in ("n_words", "n_features", "weight", "score"))
    rows = weighed(docs, gain, text_col, id_col, seed, None, names)
    if not last:
        return docs.limit(0)
    score, own = F.col(names[3]), F.col(f"`{id_col}`")
    tie = F.lit(True) if last[0][id_col] is None else own <= F.lit(last[0][id_col])
    return rows.filter((F.col(names[0]) >= min_words) & ((score > last[0]["score"]) | ((score == last[0]["score"]) & F.coalesce(tie, F.lit(False))))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name
