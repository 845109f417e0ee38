"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

Every benchmark item is cut into overlapping windows, which are looked for in all documents with at most k edits, a tenth
of their characters: windows of WINDOW characters at every STRIDE-th, and shorter ones of CLOSE_WINDOW at every
CLOSE_STRIDE-th. An exact excerpt of CLOSE_WINDOW + CLOSE_STRIDE - 1 characters or more thus always holds a window. Text
and window that match with k edits share at least m + 1 - q - k * q character q-grams (the q-gram lemma), and all of them
lie on diagonals that are at most k apart; bands of 2k diagonals that start at every k-th diagonal thus hold them
together in one band. Shared q-grams are counted by item and band first, since no window can have more of them than its
item; those of bands that reach the least count of any window are counted by window and band, and bands that reach the
window's count are verified by alignment in the band.

A text is counted in stretches of about HITS shared q-grams, which overlap by more than a window's reach: runs of one
character that both sides repeat cost time, not memory.

Items are looked up in blocks of bounded size that are sent to the tasks, so the benchmark may grow; documents pass
through once for each block, without a shuffle and without meeting one another.

Defined results: letters' case and the amount of white space don't matter; null texts match nothing; item ids may be null
and of any type, and each row of the benchmark is an item of its own except those equal in both columns; items of fewer than
MIN_CHARS characters are looked for whole and exactly, where no letter or digit adjoins them, and count as one window;
items without a letter or digit of fewer than MIN_CHARS characters name nothing and match nothing; repeated rows are reported each; offsets count characters of the document
in lower case with single spaces; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q, WINDOW, STRIDE, MIN_CHARS = 8, 80, 40, 24
CLOSE_WINDOW, CLOSE_STRIDE = 60, 8
EDITS = WINDOW // 10
BLOCK_CHARS = 1 << 20
PIECE_CHARS = 1 << 18
PAD = WINDOW + 6 * EDITS + Q
_FILTER_BITS = 22
HITS = 1 << 18
REACH = WINDOW + 4 * EDITS + Q


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int) -> int:
    """Most edits of a window of m characters: a tenth, or fewer so that a shared q-gram is still guaranteed."""
    return max(0, min(m // 10, (m - Q) // Q))


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(c: np.ndarray) -> np.ndarray:
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[k : k + n]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def spans(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of an item of n characters."""
    out = set()
    for size, stride in ((WINDOW, STRIDE), (CLOSE_WINDOW, CLOSE_STRIDE)):
        last = max(0, n - size)
        out |= {(s, min(n, s + size)) for s in (*range(0, last + 1, stride), last)}
    return sorted(out)


_WORD = re.compile(r"[^\W_]+")


def _reach(band: np.ndarray, bands: int, least: np.ndarray) -> np.ndarray:
    """Which entries lie in two neighbouring bands that hold ``least`` of their item or more."""
    key, code, n = np.unique(band, return_inverse=True, return_counts=True)
    after = np.zeros(len(key), np.int64)
    next_to = key[1:] == key[:-1] + 1
    after[:-1][next_to] = n[1:][next_to]
    enough = n + after >= least[key // bands]  # this band and the one after
    enough[1:] |= next_to & enough[:-1]
    return enough[code]


class Index:
    """The q-grams of some items, their windows, and the items that are too short for windows. An item is known by its
    place in ``items``, (item id, text)."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.chars, self.item, starts, grams, entries = [], [], [], [], []
        self.short: dict[str, list[tuple[str, int, int]]] = {}
        first, covering, base = [0], [], 0  # windows that cover each q-gram's place, by global place
        item_of, place_of = [], []
        for item, (_, text) in enumerate(items):
            t = normal(text)
            if len(t) < MIN_CHARS:
                if word := _WORD.search(t):
                    self.short.setdefault(word[0], []).append((t, word.start(), item))
                continue
            c = _chars(t)
            g = _qgrams(c)
            cut = spans(len(t))
            at = np.array(cut, np.int64)
            for s, e in cut:
                self.item.append(item)
                self.chars.append(c[s:e])
            starts.append(at[:, 0])
            grams.append(g)
            item_of.append(np.full(len(g), item))
            place_of.append(np.arange(len(g)))
            # a window covers the places start .. end - Q
            count = at[:, 1] - Q - at[:, 0] + 1
            place = np.repeat(at[:, 0] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            window = np.repeat(np.arange(len(cut)), count) + base
            order = np.argsort(place, kind="stable")
            covering.append(window[order].astype(np.int32))
            first.append(np.cumsum(np.bincount(place, minlength=len(g))) + sum(len(x) for x in covering[:-1]))
            base += len(cut)
        none = np.zeros(0, np.int64)
        join = lambda xs, like=none: np.concatenate(xs) if xs else like
        self.start = join(starts)
        self.covering, self.first = join(covering), np.concatenate([np.atleast_1d(x) for x in first])
        self.size = np.array([len(c) for c in self.chars], np.int64)
        self.edits = np.array([budget(len(c)) for c in self.chars], np.int64)
        self.least = self.size + 1 - Q - self.edits * Q
        self.item_least = np.full(len(items), 1 << 30, np.int64)
        np.minimum.at(self.item_least, np.array(self.item, np.int64), self.least)
        self.pattern = np.zeros((len(self.chars), WINDOW), np.uint32)
        for i, c in enumerate(self.chars):
            self.pattern[i, : len(c)] = c
        every = join(grams, np.zeros(0, np.uint64))
        order = np.argsort(every, kind="stable")
        self.entry = order  # global places in order of their q-gram
        self.entry_item, self.entry_place = join(item_of)[order], join(place_of)[order]
        self.grams, self.at = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.at, len(every)))
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def shared(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the q-gram) of all q-grams that the text shares with the items."""
        h = _qgrams(c)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - _FILTER_BITS)])
        g = np.searchsorted(self.grams, h[at])
        g[g == len(self.grams)] = 0
        same = self.grams[g] == h[at] if len(self.grams) else np.zeros(0, bool)
        return at[same], g[same]

    def stretches(self, at: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of ``at`` with about HITS entries each, overlapping by REACH places."""
        total = np.concatenate([[0], np.cumsum(self.count[g])])
        a = 0
        while a < len(at):
            b = int(np.searchsorted(total, total[a] + HITS, "right")) - 1
            b = max(b, int(np.searchsorted(at, at[a] + 2 * REACH)))
            yield at[a:b], g[a:b]
            if b >= len(at):
                return
            a = int(np.searchsorted(at, at[b] - REACH))

    def regions(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first diagonal) of the bands that reach the window's count, a stretch at a time; the same region may
        come from two stretches. A band is given if it has a q-gram in its first half: if not, the band after it is."""
        for at, g in self.stretches(*self.shared(c)):
            n = self.count[g]
            entry = np.repeat(self.at[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            where = np.repeat(at, n)
            item, diagonal = self.entry_item[entry], where - self.entry_place[entry]
            # bands of an item's diagonals; one of its windows can't have more than the item has in them
            low = int(diagonal.min())
            bands = int(diagonal.max() - low) // EDITS + 3
            band = item * bands + (diagonal - low) // EDITS + 1
            live = _reach(band, bands, self.item_least)
            entry, where = entry[live], where[live]
            if not len(entry):
                continue
            place = self.entry[entry]
            n = self.first[place + 1] - self.first[place]
            window = self.covering[np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())].astype(np.int64)
            diagonal = np.repeat(where - self.entry_place[entry], n) + self.start[window]
            bands = len(c) // EDITS + 2 * PAD
            key, n = np.unique(window * bands + (diagonal + PAD) // EDITS, return_counts=True)
            n[:-1] += np.where(key[1:] == key[:-1] + 1, n[1:], 0)
            key = key[n >= self.least[key // bands]]
            if len(key):
                yield key // bands, (key % bands) * EDITS - PAD

    def align(self, c: np.ndarray, window: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits between each window and the text in the band, and where that text ends.

        A match has a q-gram in the band's first half and stays within k diagonals of it, which makes 3k diagonals.
        A row's least cost never falls from one character to the next, so windows beyond their edits are left early.
        """
        wide = 3 * EDITS + 1
        base = first - EDITS
        text = np.concatenate([np.full(PAD, 10, np.uint32), c, np.full(2 * PAD, 10, np.uint32)])
        column = np.arange(wide, dtype=np.int16)
        best, end = np.full(len(window), WINDOW, np.int32), np.zeros(len(window), np.int64)
        live = np.arange(len(window))
        size, edits, pattern = self.size[window], self.edits[window], self.pattern[window]
        near = text[np.clip(base[:, None] + np.arange(wide + WINDOW) + PAD, 0, len(text) - 1)]
        cost = np.zeros((len(window), wide), np.int16)
        for i in range(1, int(size.max(initial=0)) + 1):
            new = cost + (near[:, i - 1 : i - 1 + wide] != pattern[:, i - 1][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - column, axis=1) + column
            done = size == i
            if done.any():
                best[live[done]] = cost[done].min(axis=1)
                end[live[done]] = base[live[done]] + cost[done].argmin(axis=1) + i
            if done.any() or i % 4 == 0:
                go = ~done & (cost.min(axis=1) <= edits)
                live, size, edits, pattern, near, cost = live[go], size[go], edits[go], pattern[go], near[go], cost[go]
        return best, end

    def whole(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) of the short items in a normalised text."""
        for m in _WORD.finditer(text):
            for t, lead, item in self.short.get(m[0], ()):
                a, b = m.start() - lead, m.start() - lead + len(t)
                if a >= 0 and text.startswith(t, a) and not (a and t[0].isalnum() and text[a - 1].isalnum()) and not (t[-1].isalnum() and text[b : b + 1].isalnum()):
                    yield item, a, b

    def search(self, texts: list[str], once: bool = False) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, windows, edits, begin, end) for normalised texts; with ``once`` one row for each text that has any."""
        gap = "\n" * PAD
        joined = _chars(gap.join(texts))
        starts = np.concatenate([[0], np.cumsum([len(t) + PAD for t in texts])])[:-1]
        found: dict[tuple[int, int], list] = {}
        hit = np.zeros(len(texts), bool)

        def add(text: int, item: int, window: int, edits: int, begin: int, end: int) -> None:
            hit[text] = True
            if (text, item) not in found:
                found[text, item] = [set(), edits, begin, end]
            row = found[text, item]
            row[0].add(window)
            row[1:] = [min(row[1], edits), min(row[2], begin), max(row[3], end)]

        for every, band in self.regions(joined):
            for a in range(0, len(every), 8192):
                w, first = every[a : a + 8192], band[a : a + 8192]
                if once:
                    inside = np.clip(np.searchsorted(starts, first + self.size[w] // 2, "right") - 1, 0, None)
                    w, first = w[~hit[inside]], first[~hit[inside]]
                best, end = self.align(joined, w, first)
                ok = np.flatnonzero(best <= self.edits[w])
                w, best, end = w[ok], best[ok], end[ok]
                text = np.searchsorted(starts, end - 1, "right") - 1
                end = end - starts[text]
                begin = np.maximum(0, end - self.size[w])
                # of many matches of one window in one text, one row
                key, code = np.unique(text * len(self.size) + w, return_inverse=True)
                least, low, high = np.full(len(key), WINDOW), np.full(len(key), len(joined)), np.zeros(len(key), np.int64)
                np.minimum.at(least, code, best)
                np.minimum.at(low, code, begin)
                np.maximum.at(high, code, end)
                for k, *row in zip(key.tolist(), least.tolist(), low.tolist(), high.tolist(), strict=True):
                    add(k // len(self.size), self.item[k % len(self.size)], k % len(self.size), *row)
        for text, t in enumerate(texts if self.short else ()):
            for item, a, b in self.whole(t):
                add(text, item, -1, 0, a, b)
        return [(t, i, len(ws), e, a, b) for (t, i), (ws, e, a, b) in sorted(found.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The distinct items in parts of about BLOCK_CHARS characters, each collected by itself."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r["i"], r["t"]) for r in part.collect()]


def _searched(index: Index, column: pa.Array, once: bool = False) -> Iterator[tuple[int, int, list]]:
    """(from, to, hits) for runs of values of about PIECE_CHARS characters; the values of one run alone are objects."""
    texts, size, at = [], 0, 0
    for i, value in enumerate(column):
        texts.append(normal(value.as_py()))
        size += len(texts[-1])
        if size > PIECE_CHARS or i == len(column) - 1:
            yield at, i + 1, index.search(texts, once)
            texts, size, at = [], 0, i + 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, n_windows, edits, begin, end) for each document and item of which the document holds a window."""
    out = None
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    names = ["id", "item_id", "n_windows", "edits", "begin", "end"]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    for items in _blocks(benchmark, item_col, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))  # of about BLOCK_CHARS characters

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, _, rows in _searched(index.value, batch.column(1)):
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    ids = batch.column(0).take(pa.array([at + r for r in cols[0]], pa.int64()))
                    known = pa.array([index.value.ids[i] for i in cols[1]], item_type)
                    yield pa.RecordBatch.from_arrays([ids, known, *(pa.array(list(c), pa.int64()) for c in cols[2:])], names=names)

        found = narrow.mapInArrow(run, f"id {kind}, item_id {item_kind}, n_windows long, edits long, begin long, end long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, unchanged."""
    place = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, to, rows in _searched(index.value, batch.column(place), once=True):
                    keep = np.ones(to - at, bool)
                    keep[[r[0] for r in rows]] = False
                    yield batch.slice(at, to - at).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
