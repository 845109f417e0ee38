"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and grouping.

A text's set are its distinct shingles as 64-bit hashes. SuperMinHash ranks the registers by a permutation of each
element: in round j an element offers j plus a random fraction to the j-th register of its permutation. The ranks of one
element exclude one another, which lowers the variance of a signature below that of independent minima, and once a round
has filled the last register no later one can change any: large sets stop after one round or two. Permutations go round
the registers, a prime number of them, from a random place by a random step. Any two registers so get each pair of
different ranks with equal chance, as from shuffles, and the variance, a sum over pairs of registers, is the same; but
nothing has to be kept of an element, and rounds run over the elements of many sets at once.

Sets of similarity 4/5 agree in each register with probability 4/5 or more, and in all REGISTERS of one of BANDS bands but
for a chance of (1 - 0.8 ** 6) ** 64, under 4 in 10**9. Wide bands keep lists short where texts are many: of sets of
similarity 1/20 one pair in a million meets.

Equal sets are one node, with a number of its own for a key of 128 bits. Lists of nodes by band are compared as in
:mod:`near_copies`: sizes and parity bitmaps rule out most pairs without a chance of error; each node is verified first
with its nearest candidates, and after that only pairs of different components are, so that a group of near copies of any
size costs no square of it. Each link is confirmed on both full sets.

Defined results: A-Z are lowered, words are parted by the six ASCII blanks; fewer words than a shingle's are one shingle;
texts without words (or null) are linked with nothing, copies of one another included; null ids never name a component
unless all its ids are null, and ``kept`` is true for the rows whose id names their component (null with null); repeated
rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm import near_copies as N
from webframe.llm.words import mix
from webframe.session import cut, tidy

WIDTH, BANDS, REGISTERS = 2, 64, 6
#: registers of a signature: the prime number from BANDS * REGISTERS on
LENGTH = next(n for n in range(BANDS * REGISTERS, 1 << 16) if all(n % k for k in range(2, int(n**0.5) + 1)))
#: bits of a bitmap for each member of its set: of sets of similarity 0.77 or less hardly a pair passes
SCALE = 4
#: elements of the sets that are signed at once
ELEMENTS = 1 << 17
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sign(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """Signatures (sets x LENGTH) of elements (unsigned 64-bit hashes) by the number of their set; sets aren't empty."""
    values = np.full((sets, LENGTH), _EMPTY, np.uint64)
    x, of = mix(elements), owner.astype(np.int64)
    at = (x % np.uint64(LENGTH)).astype(np.int64)
    by = 1 + ((x >> np.uint64(32)) % np.uint64(LENGTH - 1)).astype(np.int64)
    open_sets = np.arange(sets)
    for j in range(LENGTH):
        x = x + _GAMMA
        np.minimum.at(values.reshape(-1), of * LENGTH + at, np.uint64(j << 48) | (mix(x) >> np.uint64(16)))
        if j < 8 or j % 8 == 0:
            unfilled = (values[open_sets] == _EMPTY).any(axis=1)
            if not unfilled.all():
                is_open = np.zeros(sets, bool)
                open_sets = open_sets[unfilled]
                is_open[open_sets] = True
                left = is_open[of]
                x, of, at, by = x[left], of[left], at[left], by[left]
            if not len(open_sets):
                break
        at = at + by
        at[at >= LENGTH] -= LENGTH
    return values


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of sets of signed 64-bit hashes, some of which may be empty (all registers are then)."""
    out = np.full((len(sets), LENGTH), _EMPTY, np.uint64)
    held: list[int] = []
    size = 0
    for i, s in enumerate([*sets, None]):
        if s is not None and len(s):
            held.append(i)
            size += len(s)
        if held and (s is None or size >= ELEMENTS):
            owner = np.repeat(np.arange(len(held)), [len(sets[h]) for h in held])
            out[held] = sign(np.concatenate([sets[h] for h in held]).view(np.uint64), owner, len(held))
            held, size = [], 0
    return out


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """(sets x bands) hashes of the bands' registers, as signed numbers."""
    parts = signature[:, : count * REGISTERS].reshape(len(signature), count, REGISTERS)
    h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _GAMMA, parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        h = mix(h ^ parts[:, :, k]) + _GAMMA
    return h.view(np.int64)


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo, n, text_hash, bands, bits) of every row: the set's key and size, and for the first row of a batch that has
    the set also its bands and bitmap."""
    import xxhash

    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place: dict[bytes, int] = {}
            keys, sets, sizes, of, firsts = [], [], [], [], []
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                s = N.shingles(t or b"", WIDTH)
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key not in place:
                    place[key] = len(keys)
                    keys.append(key)
                    sets.append(s)
                    sizes.append(len(s))
                    firsts.append(i)
                of.append(place[key])
            many = len(keys)
            made = bands(signatures(sets)) if many else np.zeros((0, BANDS), np.int64)
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(many, 2)
            first = np.full(batch.num_rows, -1)
            first[firsts] = np.arange(many)
            known = pa.array(np.where(first < 0, 0, first), pa.int64(), mask=first < 0)
            told = lambda values: values.take(known)  # noqa: E731  null but for the first rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * BANDS, pa.int32()), pa.array(made.ravel(), pa.int64()))
            bits = pa.array([N.parity(s, SCALE) if len(s) else b"" for s in sets], pa.binary())
            columns = [batch.column(0), *(pa.array(pairs[of, c], pa.int64()) for c in (0, 1)), pa.array(np.array(sizes, np.int64)[of], pa.int64()), batch.column(2), told(lists), told(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hi", "lo", "n", "text_hash", "bands", "bits"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.xxhash64(F.col(f"`{text_col}`")))
    return rows.mapInArrow(run, f"id {kind}, hi long, lo long, n long, text_hash long, bands array<long>, bits binary")


def _sets(docs: DataFrame, text_col: str, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes. Of each one text is looked up by its hash, and no other is shingled."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [N.shingles(t or b"", WIDTH) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), "<i8").reshape(len(found), 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([s.tobytes() for s in found], pa.binary())], names=["hi", "lo", "set"])

    asked = cut(nodes.join(wanted, "node", "left_semi").select("node", "hi", "lo", "text_hash"))
    few = asked.count() <= N.SENT_KEYS
    send = lambda frame: F.broadcast(frame) if few else frame
    text = F.col(f"`{text_col}`")
    texts = docs.select(text.alias("t"), F.xxhash64(text).alias("text_hash")).join(send(asked.select("text_hash").distinct()), "text_hash", "left_semi").select("t").distinct()
    return cut(texts.mapInArrow(run, "hi long, lo long, set binary").join(send(asked.select("node", "hi", "lo")), ["hi", "lo"]).select("node", "set").dropDuplicates(["node"]))


def _confirmed(docs: DataFrame, text_col: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            same = [N.similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    have = _sets(docs, text_col, nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    side = lambda x: have.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable) and kept of every row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with tidy(docs.sparkSession):
        marks = cut(_marks(docs, id_col, text_col))
        full = marks.filter(F.col("n") > 0)
        same = full.groupBy("hi", "lo").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("text_hash").alias("text_hash"), F.min("bands").alias("bands"), F.min("bits").alias("bits"))
        nodes = cut(same.repartition(parts, "hi", "lo")).withColumn("node", F.monotonically_increasing_id())
        postings = nodes.select(F.explode("bands").alias("s"), "n", F.col("node").alias("key"), F.lit(1).cast("long").alias("lead"))
        lists = cut(N._lists(postings, parts))
    bitmaps = nodes.select(F.col("node").alias("key"), "n", "bits")
    found = N.linked(lists, bitmaps, lambda pairs: _confirmed(docs, text_col, nodes, pairs), rounds=2)
    grouped = nodes.select("hi", "lo", "least", "node").join(found, "node", "left").select("hi", "lo", "least", F.coalesce("component", "node").alias("part"))
    least = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    named = cut(grouped.join(least, "part").select("hi", "lo", "component_id"))
    linked = full.select("id", "n", "hi", "lo").join(named, ["hi", "lo"]).select("id", "n", "component_id")
    every = linked.unionByName(marks.filter(F.col("n") == 0).select("id", "n", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
