"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Each set has a SimHash fingerprint, and :mod:`simhash` finds those that are near: byte-position index, tally of shared bytes,
count filter, verification by bits. Its pairs are candidates that the whole sets confirm.

SimHash alone can't find all: texts of similarity 0.8 differ in about 10 of 64 bits, often in more, and at such a radius two
fingerprints are certain to share no byte. What it leaves is found through a prefix index. The sets themselves give a
guarantee: put in one order, sets of similarity
4/5 or more share one of their first n - ceil(4n/5) + 1 members (the prefix-filter principle), whatever the order is.
Shingles that a sample of texts shows to be common come last in it, so that few lists are long; the sample decides
nothing else. Candidates are verified by their whole sets.

Of two such sets the smaller has a shared member among its first n - ceil(8n/9) + 1, its lead; a list's members that are
smaller than its first lead pair with nothing there and leave it.

Each set also has a parity bitmap of about as many bits as members: a bit is set if an odd number of members fall on it.
Two bitmaps differ in at most as many bits as the sets differ in members, which is a ninth of both sizes at similarity
4/5, so most candidates are dropped by their bitmaps without a look at their sets, and none that is similar enough.

A list's members are first met with the list's smallest set and with their neighbours in the order of size, in partitions
sorted by range, as a list may be of any length. Only pairs that are not in one component after that are all compared, so that a large group of near copies costs no square of its size; lists that still hold several components
pass on the pairs that their bitmaps allow, and long ones are dealt by pairs of chunks, so that no list is gathered whole.

Defined results: words are parted by ASCII blanks and A-Z are lowered, as in :mod:`simhash`; fewer than WIDTH words are
one shingle; texts without words are copies of one another; components are named by the least key of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm import simhash
from webframe.llm.components import components, joined
from webframe.llm.words import mix
from webframe.session import batches_of, cut, tidy

WIDTH = 5
#: least similarity, as a fraction
OVER, UNDER = 4, 5
#: texts of the sample, texts that make a shingle common, and most common ones sent: they order sets and decide nothing else
SAMPLE_TEXTS, COMMON, SENT_COMMON = 5_000, 3, 1_000_000
SENT_KEYS = 200_000
CHUNK = 1_000
#: rows that a worker gets at once
ROWS = 1_000


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64).view(np.int64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((known[x] if x in known else known.setdefault(x, digest(x)) for x in words), np.uint64, len(words))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique((h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def key_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes()) >> 1


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set's members."""
    return simhash.majority(mix(s.view(np.uint64)).astype(">u8").view(np.uint8))


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first members of a sorted set of which one is shared by any set that is similar enough."""
    need = len(s) + (OVER * len(s)) // -UNDER + 1 if len(s) else 0
    if len(common) and len(s):
        at = np.searchsorted(common, s)
        late = common[np.minimum(at, len(common) - 1)] == s
        s = np.concatenate([s[~late], s[late]])
    return s[:need]


def lead_of(n: np.ndarray) -> np.ndarray:
    """How many first members of a set's prefix are its lead: all larger sets that are similar enough share one of them."""
    return n + (2 * OVER * n) // -(OVER + UNDER) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _common(docs: DataFrame, text_col: str) -> np.ndarray:
    """The shingles that COMMON different texts or more of a sample hold, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64())], names=["s"])

    part = max(1, docs.count() // SAMPLE_TEXTS)
    texts = docs.select(text_col).filter(F.pmod(F.xxhash64(text_col), F.lit(part)) == 0).distinct()
    rows = texts.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(SENT_COMMON)
    return np.sort(np.asarray(rows.select("s").toArrow().column(0).to_numpy()).astype(np.int64))


def parity(s: np.ndarray, scale: int = 1) -> bytes:
    """The bitmap of a set: 64 bits, or the power of two from ``scale`` times its size on. The more bits, the fewer members
    fall on one of them and the nearer is the bound."""
    bits = max(64, 1 << max(0, scale * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as those of ``size`` bytes. ``packbits`` keeps the order of bits, so halves fold."""
    while bitmaps.shape[-1] > size:
        half = bitmaps.shape[-1] // 2
        bitmaps = bitmaps[..., :half] ^ bitmaps[..., half:]
    return bitmaps


_BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _pair_batch(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def _lists(postings: DataFrame, parts: int) -> DataFrame:
    """(s, n, key, lead) of the members of lists from their first lead on, if they are two or more, sorted in partitions
    of ranges. A partition's first and last list may go on in others and are kept. Copies are one member."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, led, first = np.zeros((4, 0), np.int64), False, False, None
        for batch in batches:
            rows = np.concatenate([last, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            once = np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
            rows = rows[:, once]
            s = rows[0]
            first = s[0] if first is None else first
            same = s[1:] == s[:-1]
            start = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(s)), 0))
            leads = np.maximum.accumulate(np.where(rows[3] > 0, np.arange(len(s)), -1)) >= start
            leads |= led & (start == 0)  # the list goes on from the batch before
            keep = np.zeros(len(s), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= held
            keep = keep & leads | (s == first)
            last, held, led = rows[:, -1:], bool(keep[-1]), bool(leads[-1])
            out = rows[:, :-1][:, keep[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["s", "n", "key", "lead"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=["s", "n", "key", "lead"])

    ordered = postings.select("s", "n", "key", "lead").repartitionByRange(parts, "s", "n", "key").sortWithinPartitions("s", "n", "key")
    return ordered.mapInArrow(shared, "s long, n long, key long, lead long")


def _first_candidates(lists: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v: each list's members in a partition with its smallest there, and with the next larger."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin = np.zeros((3, 0), np.int64), np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:3]])], axis=1)
            if not rows.shape[1]:
                continue
            s, n, key = rows
            head = np.append(True, s[1:] != s[:-1])
            at = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
            n0, key0 = n[at], key[at]
            if begin.shape[1] and begin[0, 0] == s[0]:  # the list goes on from the batch before
                n0[at == 0], key0[at == 0] = begin[1, 0], begin[2, 0]
            us, vs = [], []
            for m, other in ((n0[1:], key0[1:]), (n[:-1], key[:-1])):
                fits = ~head[1:] & (UNDER * m >= OVER * n[1:]) & (other != key[1:])
                us.append(key[1:][fits])
                vs.append(other[fits])
            last, begin = rows[:, -1:], np.array([[s[-1]], [n0[-1]], [key0[-1]]])
            yield _pair_batch(us, vs)

    return lists.mapInArrow(beside, "u long, v long").distinct()


def simhash_candidates(distinct: DataFrame, parts: int) -> DataFrame:
    """Distinct (u, v), u > v, of keys whose fingerprints SimHash links, from (key, fp). The least key stands for all of its
    fingerprint, with which each of the others is a pair, so that pairs are linear in the sets."""
    least = cut(distinct.groupBy("fp").agg(F.min("key").alias("least")).repartition(parts, "fp"))
    side = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"k{x}"))
    between = simhash.links(least.select("fp")).join(side("u"), "u").join(side("v"), "v").select("ku", "kv")
    alike = distinct.select("fp", "key").join(least, "fp").filter(F.col("key") != F.col("least")).select("key", "least")
    return between.union(alike).select(F.greatest("ku", "kv").alias("u"), F.least("ku", "kv").alias("v")).distinct()


def _differing(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    return _BIT_COUNT[rows ^ row].sum(axis=-1, dtype=np.int64)


def _pairs(key, n, part, chunk, lead, bits, alone: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, places, differing bits) for the pairs of members of a list that are not of one ``part`` and that sizes, leads and
    bitmaps allow, each pair once; all pairs of a chunk if ``alone``, else those between two chunks."""
    size = np.array([len(x) for x in bits])
    for c in np.unique(size):
        near = np.flatnonzero((size == c) | (size == 2 * c))  # sizes of a pair differ by a quarter at most
        rows = np.concatenate([folded(np.frombuffer(bits[k], np.uint8), c)[None] for k in near])
        for i in np.flatnonzero(size[near] == c):
            j = np.flatnonzero((part[near] != part[near[i]]) & ((size[near] > c) | (np.arange(len(near)) > i)))
            j = j if alone else j[chunk[near[j]] != chunk[near[i]]]
            m, own = n[near[j]], n[near[i]]
            j = j[(((m <= own) & lead[near[j]]) | ((m >= own) & lead[near[i]])) & (UNDER * np.minimum(m, own) >= OVER * np.maximum(m, own))]
            if len(j):
                bits_off = _differing(rows[j], rows[i])
                ok = (UNDER + OVER) * bits_off <= (UNDER - OVER) * (n[near[j]] + own)
                if ok.any():
                    yield near[i], near[j[ok]], bits_off[ok]


def _members(batch: pa.RecordBatch, at: int) -> Iterator[tuple]:
    """The columns of each list's members: a list at a time, as a batch holds many."""
    for i in range(batch.num_rows):
        m = batch.column(at)[i].values
        key, n, part, chunk, lead = (np.asarray(m.field(x)).astype(np.int64) for x in ("key", "n", "part", "chunk", "lead"))
        yield key, n, part, chunk, lead > 0, m.field("bits").to_pylist()


def _mixed(lists: DataFrame, bitmaps: DataFrame, salt: int) -> DataFrame:
    """The members of lists of several parts, with their bitmaps and one of the list's ``chunks``."""
    mixed = lists.groupBy("s").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("m")).filter(F.col("lo") != F.col("hi"))
    held = lists.join(mixed, "s").join(bitmaps.select("key", "bits"), "key").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    return held.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(salt)), F.col("chunks")).cast("int"))


def _nearest_others(lists: DataFrame, bitmaps: DataFrame, salt: int) -> DataFrame:
    """(u, v), u > v: for each member of lists of several parts the one of another part whose bitmap is nearest, of those
    that are in a chunk with it. Linear in the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, part, chunk, lead, bits in _members(batch, 0):
                best = np.full(len(key), np.iinfo(np.int64).max)
                to = np.full(len(key), -1)
                for i, js, off in _pairs(key, n, part, chunk, lead, bits, True):
                    far = (off << 20) // (n[js] + n[i])
                    k = int(np.argmin(far))
                    if far[k] < best[i]:
                        best[i], to[i] = far[k], js[k]
                    nearer = far < best[js]
                    best[js[nearer]], to[js[nearer]] = far[nearer], i
                have = to >= 0
                yield pa.RecordBatch.from_arrays([pa.array(key[have]), pa.array(key[to[have]]), pa.array(best[have])], names=["own", "other", "far"])

    met = _mixed(lists, bitmaps, salt).groupBy("s", "chunk").agg(_gathered()).filter(F.size("m") > 1).select("m")
    found = met.mapInArrow(run, "own long, other long, far long").groupBy("own").agg(F.min_by("other", F.struct("far", "other")).alias("other"))
    return found.select(F.greatest("own", "other").alias("u"), F.least("own", "other").alias("v")).distinct()


def _gathered():
    return F.collect_list(F.struct("key", "n", "part", "chunk", "lead", "bits")).alias("m")


def _other_candidates(lists: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v, of members of one list that are not of one ``part`` and that their bitmaps allow. Lists of
    one part have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for alone, (key, *rest) in zip(batch.column(0).to_pylist(), _members(batch, 1), strict=True):
                found = [(np.full(len(js), key[i]), key[js]) for i, js, _ in _pairs(key, *rest, alone)]
                if found:
                    yield _pair_batch(*map(list, zip(*found, strict=True)))

    held = _mixed(lists, bitmaps, 0)
    dealt = held.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = dealt.groupBy("s", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).agg(_gathered())
    return met.filter(F.size("m") > 1).select((F.col("a") == F.col("b")).alias("alone"), "m").mapInArrow(run, "u long, v long").distinct()


def _allowed(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(u, v, far) of the pairs that their bitmaps allow: how far the bitmaps are from one another, by the sets' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(k)).astype(np.int64) for k in (2, 4))
            off = np.zeros(batch.num_rows, np.int64)
            for k, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                size = min(len(a), len(b))
                off[k] = _differing(folded(np.frombuffer(a, np.uint8), size), folded(np.frombuffer(b, np.uint8), size))
            keep = (UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)) & ((UNDER + OVER) * off <= (UNDER - OVER) * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((off << 20) // np.maximum(n + m, 1))], names=["u", "v", "far"]).filter(pa.array(keep))

    side = lambda x: bitmaps.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "bu", "nv", "bv").mapInArrow(run, "u long, v long, far long")


def linked(lists: DataFrame, bitmaps: DataFrame, confirm, rounds: int = 0, near: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that have links. ``lists``: s, n, key, lead; ``bitmaps``: key, n, bits; ``confirm`` keeps
    the pairs (u, v) that are similar enough by their sets. ``near``: pairs (u, v), u > v, that are candidates too.

    Without ``rounds`` all first candidates are confirmed. With them each node is confirmed with the nearest of these alone,
    and in each round with the nearest of another component: fewer sets travel, but lists are looked through in each. Either
    way groups are whole but for few nodes before all pairs of different components that a list holds are confirmed.
    """
    told = lambda: lists.join(found, lists["key"] == found["node"], "left").select("s", "key", "n", "lead", F.coalesce("component", "key").alias("part"))
    with tidy(lists.sparkSession):
        met = _first_candidates(lists)
        first = _allowed(met if near is None else met.union(near).distinct(), bitmaps)
        tried = cut(first.groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v")) if rounds else first.select("u", "v"))
        found = cut(components(confirm(tried)))
        for salt in range(1, rounds + 1):
            more = cut(_nearest_others(told(), bitmaps, salt).join(tried, ["u", "v"], "left_anti"))
            found = joined(found, confirm(more))
            tried = tried.union(more)
        rest = cut(_other_candidates(told(), bitmaps).join(tried, ["u", "v"], "left_anti"))
        return joined(found, confirm(rest)) if rest.limit(1).count() else found


def _verified(docs: DataFrame, text_col: str, pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough. Of each set one text is looked up by its hash, and no other is shingled."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            same = [similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    wanted = cut(distinct.select("key", "text_hash").join(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "key", "left_semi").select("text_hash").distinct())
    side = F.broadcast(wanted) if wanted.count() <= SENT_KEYS else wanted
    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("text_hash")).join(side, "text_hash", "left_semi")
    have = cut(texts.select("t").mapInArrow(sets, "key long, set binary").dropDuplicates(["key"]))
    met = pairs.join(have.select(F.col("key").alias("u"), F.col("set").alias("su")), "u").join(have.select(F.col("key").alias("v"), F.col("set").alias("sv")), "v")
    return met.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def texts_of_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, key, group) of each text by its xxhash64: a key of its shingle set, and the group of its near copies. Texts
    go to Python for this by ROWS, and once more for the prefixes; rows find their groups by the hash without Python."""
    spark = docs.sparkSession

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            cols = [pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), pa.array([fingerprint(s) for s in sets], pa.int64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "bits", "fp", "text_hash"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            fresh = []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                found = shingles(t or b"")
                key = key_of(found)
                if key not in known:
                    known.add(key)
                    fresh.append((key, found))
            sets = [s for _, s in fresh]
            cols = [pa.array([k for k, _ in fresh], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([prefix(s, common.value) for s in sets], pa.list_(pa.int64())), pa.array(lead_of(np.array([len(s) for s in sets], np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "prefix", "lead"])
            if len(known) > SENT_KEYS:
                known.clear()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(text_col, F.xxhash64(text_col).alias("text_hash"))
    with tidy(spark), batches_of(spark, ROWS):
        common = spark.sparkContext.broadcast(_common(docs, text_col))
        # the prefixes are many times as large as the rest: they go to their lists at once and are not written for later
        each = cut(texts.mapInArrow(marks, "key long, n long, bits binary, fp long, text_hash long").dropDuplicates(["text_hash"]))
        distinct = cut(each.dropDuplicates(["key"]))
        postings = texts.select(text_col).mapInArrow(prefixes, "key long, n long, prefix array<long>, lead long").select("key", "n", "lead", F.posexplode("prefix").alias("at", "s"))
        lists = cut(_lists(postings.select("s", "n", "key", (F.col("at") < F.col("lead")).cast("long").alias("lead")), parts))
        near = cut(simhash_candidates(distinct.select("key", "fp"), parts))
        found = linked(lists, distinct, lambda pairs: _verified(docs, text_col, pairs, distinct), near=near)
    return cut(each.join(found, each["key"] == found["node"], "left").select("text_hash", "key", F.coalesce("component", "key").alias("group")))


def sent(small: DataFrame) -> DataFrame:
    """``small``, which is cut, to be sent to the rows that it meets if it is small."""
    return F.broadcast(small) if small.count() <= SENT_KEYS else small


def groups(docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("__key", "__group")) -> DataFrame:
    """The rows of ``docs`` with a key of the text's shingle set, and the group of its near copies, under two names that
    ``docs`` doesn't have."""
    found = texts_of_groups(docs, text_col)
    met = docs.join(sent(found), F.xxhash64(docs[text_col]) == found["text_hash"])
    return met.select(*[docs[c] for c in docs.columns], found["key"].alias(names[0]), found["group"].alias(names[1]))
