"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 8 positional bytes. Two fingerprints that differ in 2 bits or fewer share 6 of them or more: 6 is the
guaranteed count. A posting list of the index belongs to four positions and their bytes. The positions are paired to
four units, of which a pair that reaches the count shares two or more whole, so the six lists of two units hold every
such pair (lists of a single positional byte would each hold a 256th of all fingerprints). In a list the positional
bytes shared by each pair are tallied, pairs that reach the count are retained, and these are verified by their bits.

A list of more than LIST members is not gathered: its members go on to the lists that share two more positions, of
which six cover the pairs that reach the count. Those lists' members differ in two bytes at most, hence there are at
most 65,536 of them whatever the input, and their links are looked up instead of compared in pairs. Each list gives one
edge from each linked member to the least of its kind rather than all pairs, so edges grow with the members.

Copies count once: the index holds distinct fingerprints, and these, not ids, are the nodes of the components, so that
ids may have any value.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words
than a shingle's are one shingle; null ids never name a component unless all its ids are null; repeated rows stay; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.components import components
from webframe.session import cut

WIDTH, SEED, MAX_BITS = 3, 42, 2
POSITIONS = 8
#: differing bits touch as many positional bytes at most
SHARED = POSITIONS - MAX_BITS
LIST = 256


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash as a signed integer."""
    import xxhash

    words = text.lower().split()  # bytes.lower maps A-Z alone; bytes.split splits at the six ASCII blanks alone
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes (8 bytes each, the highest first) have, as a signed integer."""
    bits = np.unpackbits(hashes.reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(ones).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"id {kind}, fp long")


_BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_FLIPS = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))], np.int64)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes fingerprints share."""
    differ = np.ascontiguousarray(a ^ b)
    return (differ.view(np.uint8).reshape(*differ.shape, POSITIONS) == 0).sum(axis=-1)


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = np.ascontiguousarray(a ^ b)
    return _BIT_COUNT[differ.view(np.uint8).reshape(*differ.shape, POSITIONS)].sum(axis=-1) <= MAX_BITS


def tallied_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least linked member) of a short list: each pair's shared bytes are tallied, pairs that reach the
    guaranteed count are verified. ``fp``: distinct, in ascending order of their signed values."""
    i, j = np.triu_indices(len(fp), 1)
    kept = np.flatnonzero(tally(fp[i], fp[j]) >= SHARED)
    kept = kept[verified(fp[i[kept]], fp[j[kept]])]
    i, j = i[kept], j[kept]
    label = np.arange(len(fp))
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(fp))
    return fp[own], fp[label[own]]


def _squeeze(fp: np.ndarray) -> np.ndarray:
    """The two bytes in which a list's members differ, as one number under 65,536."""
    differ = np.bitwise_or.reduce(fp ^ fp[0])
    places = [k for k in range(POSITIONS) if int(differ) >> (8 * k) & 255]
    out = np.zeros(len(fp), np.int64)
    for n, k in enumerate(places):
        out |= ((fp >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) << (8 * n)
    return out


def looked_up_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same edges for a list whose members share six positional bytes: all have the guaranteed count, and the
    neighbours within MAX_BITS of each are looked up."""
    spot = _squeeze(fp)
    label_at = np.full(1 << 16, len(fp), np.int64)
    label_at[spot] = np.arange(len(fp))
    while True:
        new = np.concatenate([label_at[part[:, None] ^ _FLIPS].min(axis=1) for part in np.array_split(spot, max(1, len(spot) // 4096))])
        if (new == label_at[spot]).all():
            break
        label_at[spot] = new
    label = label_at[spot]
    own = label != np.arange(len(fp))
    return fp[own], fp[label[own]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.diff(np.asarray(batch.column(0).offsets))
        fp = np.asarray(batch.column(0).flatten()).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        two = at[size == 2]
        a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        two = two[(tally(a, b) >= SHARED) & verified(a, b)]
        us, vs = [np.maximum(fp[two], fp[two + 1])], [np.minimum(fp[two], fp[two + 1])]
        for k, n in zip(at[size > 2], size[size > 2], strict=True):
            members = np.sort(fp[k : k + n]).view(np.uint64)
            u, v = tallied_links(members) if n <= LIST else looked_up_links(members)
            us.append(u.view(np.int64))
            vs.append(v.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])


def _bytes_at(positions: tuple[int, ...]) -> Column:
    """(positions, bytes): the key of a list, the bytes at ``positions`` with zeros elsewhere."""
    mask = sum(255 << (8 * k) for k in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.struct(F.lit(sum(1 << k for k in positions)).cast("short").alias("positions"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bytes"))


UNITS = ((0, 1), (2, 3), (4, 5), (6, 7))


def postings(distinct: DataFrame) -> DataFrame:
    """(members) of every list with two fingerprints or more. Long lists are counted first, not gathered."""
    by = ["positions", "bytes"]
    lists = [a + b for a, b in combinations(UNITS, 2)]
    rows = distinct.select("fp", F.explode(F.array(*[_bytes_at(p) for p in lists])).alias("p")).select("p.positions", "p.bytes", "fp")
    size = cut(rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > LIST).select(*by))
    short = rows.join(size, by, "left_anti")
    held = rows.join(size, by, "left_semi")
    finer = F.lit(None)
    for p in lists:
        rest = [k for k in range(POSITIONS) if k not in p]
        finer = F.when(F.col("positions") == sum(1 << k for k in p), F.array(*[_bytes_at((*p, *q)) for q in combinations(rest, 2)])).otherwise(finer)
    long = held.select("fp", F.explode(finer).alias("p")).select("p.positions", "p.bytes", "fp")
    gather = lambda r, f: r.groupBy(*by).agg(f("fp").alias("members")).filter(F.size("members") > 1).select("members")
    # six positions may follow from several lists of four, hence sets
    return gather(short, F.collect_list).unionByName(gather(long, F.collect_set))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, between distinct fingerprints (fp): index, tally, count filter and verification by bits."""
    return postings(distinct).mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of every row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = cut(fingerprints(docs, id_col, text_col, width))
    # dealt again by number, as few bytes would else be merged into few tasks, and the index is many times as large
    distinct = cut(marks.groupBy("fp").agg(F.min("id").alias("least")).repartition(parts, "fp"))
    found = cut(components(links(distinct)))
    met = distinct.join(found, distinct["fp"] == found["node"])
    smallest = met.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = found.join(smallest, "component").select("node", "smallest")
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))
    return marks.join(cut(named), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
