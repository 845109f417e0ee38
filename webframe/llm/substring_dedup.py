"""Exact substring dedup by fixed-block anchors.

A window of 13 words is a repeat if its word sequence also starts in a document with a smaller id. Blocks of 7 words
at multiples of 7 (13 >= 2 * 7 - 1, so each window holds exactly one whole block) are the index; every rolling 7-word
window of every document is a probe. If a window is in two documents, the block of each lies in the other as a probe, so
both windows are found through their own block. The work runs in batches of documents that are dealt by a hash of id and
text, so that neither an id nor a source fills one:

1. each batch sends its distinct probes, a bit telling which of them are also blocks of the index, packed by bucket;
   a bucket answers with the probes that it saw in two batches or more and that are a block in at least one of them;
2. blocks so answered, and those that another document of the same batch has as a probe, are hits. Each batch extends
   its hits to the windows around them and sends these, each once with the smallest id of the batch that has it; a bucket
   answers a batch with the windows that another batch has with a smaller id;
3. each batch marks the windows answered and those that a smaller id of its own has, found through its own hits, and
   joins overlapping windows to maximal repeats by covering their words.

A key is sent once by a batch however many of its documents have it, so a passage that a third of all rows share costs
one entry for each batch, and no pair of documents is ever formed. Packed rows are at most as many as the keys in them.
Probes are 31 bits inside their bucket, and buckets grow in number with the input; a chance hit of the probe only sends
a window. Windows are equal if 96 bits of two hashes are, which come from two hashes of each word's bytes.

Defined results: a null or empty text, or one of fewer than 13 words, loses nothing; a row with a null id neither
loses words nor is a source of repeats; rows with equal ids are not smaller than one another; repeated rows all stay, and
go to one batch if they are equal in id and text; ids are integers; extra columns are carried unchanged, but for those
that have one of the names given for the results, which are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webframe.llm import words as W
from webframe.session import input_bytes

BATCH_BYTES = 2 << 20
NAMES = ("__n_words", "__n_removed", "__kept")
_PACKED = "bucket int, batch int, keys binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary())])
#: a window: two hashes of its words; sent with the smallest id of a batch
_WINDOW = np.dtype([("h", "<u8"), ("c", "<u4")])
_SENT = np.dtype([("h", "<u8"), ("c", "<u4"), ("id", "<i8")])


def _pack(batch: int, bucket: np.ndarray, keys: np.ndarray) -> pa.Table:
    """One row for each bucket; ``bucket`` is sorted."""
    found, at = np.unique(bucket, return_index=True)
    ends = np.append(at[1:], len(bucket))[: len(at)]  # none of none
    blobs = [keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
    return pa.table([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), batch, np.int32)), pa.array(blobs, pa.binary())], schema=_PACKED_ARROW)


def _unpack(table: pa.Table, by: str, kind) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(b, kind) for b in table["keys"].to_pylist()]
    label = np.repeat(table[by].to_numpy(), [len(k) for k in keys]) if keys else np.zeros(0, np.int32)
    return (np.concatenate(keys) if keys else np.zeros(0, kind)), label


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    head = np.ones(len(columns[0]), bool)
    if len(head):
        head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return head


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


class _Batch:
    """The words of a batch's documents."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, width: int):
        self.width, self.block = width, (width + 1) // 2
        self.ids = np.asarray(ids.cast(pa.int64()).to_numpy()).astype(np.int64)
        self.words, self.others, self.offsets = W.tokenise(texts)
        self.owner = W.owner(self.offsets)
        self.valid = W.inside(self.offsets, width)
        self.rolled = W.rolling(self.words, self.block)
        self.place = np.arange(len(self.words), dtype=np.int32) - self.offsets[:-1].astype(np.int32)[self.owner]

    def probes(self) -> np.ndarray:
        """Which rolling blocks lie in some window of one document."""
        r = self.rolled
        marks = np.zeros(len(r) + 1, np.int32)
        marks[: len(self.valid)] += self.valid
        reach = self.width - self.block + 1
        tail = np.zeros(len(r) + 1, np.int32)
        tail[reach : reach + len(self.valid)] = self.valid[: max(0, len(r) + 1 - reach)]
        return np.cumsum(marks - tail)[: len(r)] > 0

    def keyed(self, buckets: int) -> np.ndarray:
        """bucket << 32 | 31 bits << 1"""
        bucket = (self.rolled >> np.uint64(32)) % np.uint64(buckets)
        return (bucket << np.uint64(32)) | ((self.rolled & np.uint64(0x7FFFFFFF)) << np.uint64(1))

    def shared_inside(self) -> np.ndarray:
        """Which rolling blocks two documents of the batch have."""
        use = np.flatnonzero(self.probes())
        order = use[np.argsort(self.rolled[use], kind="stable")]
        at = np.flatnonzero(_heads(self.rolled[order]))
        ends = np.append(at[1:], len(order))
        many = self.owner[order[at]] != self.owner[order[ends - 1]] if len(at) else np.zeros(0, bool)
        out = np.zeros(len(self.rolled), bool)
        out[order] = np.repeat(many, ends - at)
        return out

    def extended(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows whose own block is a hit."""
        starts = np.flatnonzero(self.valid)
        return starts[hit[starts + -self.place[starts] % self.block]]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return W.rolling(self.words, self.width)[starts], W.second_rolling(self.others, self.width)[starts]

    def first(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, head, repeated) of windows sorted by their words, then id."""
        h, c = self.windows(starts)
        own = self.ids[self.owner[starts]]
        order = np.lexsort((own, c, h))
        head = _heads(h[order], c[order])
        least = own[order][head][np.cumsum(head) - 1] if len(order) else own
        return order, head, own[order] > least


def _send_probes(width: int, buckets: int):
    def send(key: tuple, docs: pa.Table) -> pa.Table:
        b = _Batch(docs["id"], docs["text"], width)
        k = b.keyed(buckets) | (b.place[: len(b.rolled)] % b.block == 0).astype(np.uint64)
        k = np.sort(k[b.probes()])
        last = np.append((k[1:] >> np.uint64(1)) != (k[:-1] >> np.uint64(1)), True) if len(k) else np.zeros(0, bool)
        k = k[last]  # with the bit of the index, if any of the equal ones has it
        return _pack(key[0].as_py(), k >> np.uint64(32), k.astype(np.uint32))

    return send


def _answer(key: tuple, k: np.ndarray, batch: np.ndarray, hit: np.ndarray) -> pa.Table:
    k, batch = k[hit], batch[hit]
    order = np.argsort(batch, kind="stable")
    k, batch = k[order], batch[order]
    found, at = np.unique(batch, return_index=True)
    blobs = [x.tobytes() for x in np.split(k, at[1:])] if len(found) else []
    return pa.table([pa.array(np.full(len(found), key[0].as_py(), np.int32)), pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], schema=_PACKED_ARROW)


def _match_probes(key: tuple, rows: pa.Table) -> pa.Table:
    k, batch = _unpack(rows, "batch", np.uint32)
    order = np.argsort(k >> np.uint32(1), kind="stable")
    k, batch = k[order], batch[order]
    if not len(k):
        return _PACKED_ARROW.empty_table()
    at = np.flatnonzero(_heads(k >> np.uint32(1)))
    size = np.diff(np.append(at, len(k)))
    hit = (size >= 2) & (np.add.reduceat((k & np.uint32(1)).astype(np.int64), at) > 0)
    return _answer(key, k >> np.uint32(1), batch, np.repeat(hit, size))


def _send_windows(width: int, buckets: int):
    def send(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _PACKED_ARROW.empty_table()
        b = _Batch(docs["id"], docs["text"], width)
        k, bucket = _unpack(hits, "bucket", np.uint32)
        table = np.sort((bucket.astype(np.uint64) << np.uint64(32)) | (k.astype(np.uint64) << np.uint64(1)))
        # what only this batch has needs no answer
        starts = b.extended(_in_sorted(b.keyed(buckets), table))
        order, head, _ = b.first(starts)
        starts = starts[order[head]]
        sent = np.empty(len(starts), _SENT)
        sent["h"], sent["c"] = b.windows(starts)
        sent["id"] = b.ids[b.owner[starts]]
        to = (sent["h"] >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        return _pack(key[0].as_py(), to[order], sent[order])

    return send


def _match_windows(key: tuple, rows: pa.Table) -> pa.Table:
    w, batch = _unpack(rows, "batch", _SENT)
    order = np.lexsort((w["id"], w["c"], w["h"]))
    w, batch = w[order], batch[order]
    head = _heads(w["h"], w["c"])
    least = w["id"][head][np.cumsum(head) - 1] if len(w) else w["id"]
    return _answer(key, w[["h", "c"]].astype(_WINDOW), batch, w["id"] > least)


def _mark(b: _Batch, earlier: np.ndarray) -> np.ndarray:
    """Which words of the batch are covered by a repeat."""
    starts = b.extended(b.shared_inside())
    order, _, again = b.first(starts)
    repeats = [starts[order[again]]]
    starts = np.flatnonzero(b.valid)
    if len(earlier) and len(starts):
        starts = starts[_in_sorted(W.rolling(b.words, b.width)[starts], np.sort(earlier["h"]))]
        x = np.empty(len(starts), _WINDOW)
        x["h"], x["c"] = b.windows(starts)
        repeats.append(starts[np.isin(x, earlier)])
    s = np.unique(np.concatenate(repeats))
    edge = np.zeros(len(b.words) + 1, np.int32)
    edge[s] += 1
    edge[s + b.width] -= 1
    return np.cumsum(edge)[:-1] > 0


def _results(offsets: np.ndarray, texts: pa.ChunkedArray, gone: np.ndarray) -> list[pa.Array]:
    """Words, words removed, and the words kept, of each text."""
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
    kept = []
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        parts = (text or b"").split()
        kept.append(b" ".join(itertools.compress(parts, ~gone[offsets[i] : offsets[i + 1]]) if removed[i] else parts).decode("utf-8", "replace"))
    return [pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]


def _finish(width: int, rest: list[str], schema: pa.Schema):
    def finish(key: tuple, docs: pa.Table, repeats: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        b = _Batch(docs["id"], docs["text"], width)
        gone = _mark(b, _unpack(repeats, "batch", _WINDOW)[0])
        new = _results(b.offsets, docs["text"], gone)
        return pa.table([*(docs[c] for c in rest), *new], names=schema.names).cast(schema)

    return finish


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with the number of words, of words removed, and the words left, joined by one space."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])  # names of our own
    own, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(parts, -(-input_bytes(docs) // BATCH_BYTES))
    buckets = batches  # each holds about as many keys as a batch sends
    rest = [c for c in docs.columns if c not in (own, text)]
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    named = docs.filter(F.col(own).isNotNull()).withColumnsRenamed({own: "id", text: "text"})
    by_batch = named.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int")).groupBy("batch")
    probes = by_batch.applyInArrow(_send_probes(width, buckets), _PACKED)
    hits = probes.groupBy("bucket").applyInArrow(_match_probes, _PACKED)
    found = by_batch.cogroup(hits.groupBy("batch")).applyInArrow(_send_windows(width, buckets), _PACKED)
    repeats = found.groupBy("bucket").applyInArrow(_match_windows, _PACKED)
    order = {own: "id", text: "text"} | {c: c for c in rest}
    schema = to_arrow_schema(out)
    done = by_batch.cogroup(repeats.groupBy("batch")).applyInArrow(_finish(width, [order[c] for c in docs.columns], schema), out)

    def nameless(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            texts = pa.chunked_array([batch.column(batch.schema.get_field_index(text))])
            hashes, _, offsets = W.tokenise(texts)
            yield from pa.table([*batch.columns, *_results(offsets, texts, np.zeros(len(hashes), bool))], names=schema.names).cast(schema).to_batches()

    done = done.unionByName(docs.filter(F.col(own).isNull()).mapInArrow(nameless, out))
    return done.toDF(*columns, *names)
