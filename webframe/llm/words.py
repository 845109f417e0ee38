"""Vectorised words and rolling word hashes over Arrow string columns.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return,
which is the pattern ``[^\\x20\\x09-\\x0D]+`` since all six are single bytes in UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xA0761D6478BD642F)
LONG = 256
#: windows that are hashed at once
CHUNK = 1 << 16
#: the first k of 8 bytes
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n, kept for the worker's next batches."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(1 << 16, n + n // 4)
        pair = []
        for b in (base, np.uint64(pow(key, -1, 1 << 64))):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            pair.append(np.multiply.accumulate(t))
        _powers[key] = (pair[0], pair[1])
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _span_hash(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _digests(piece: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word's bytes: chunks of 8 bytes of all words together are mixed into two states of their own
    seeds and factors, so that no two words of up to 8 bytes are alike. Words over LONG bytes are hashed one by one."""
    padded = np.append(piece, np.zeros(8, np.uint8))
    windows = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    one, two = np.full(len(starts), _BASE, np.uint64), np.full(len(starts), _STEP, np.uint64)
    active, at, rest = np.arange(len(starts)), starts, np.where(lengths > LONG, 0, lengths)
    while True:
        some = rest > 0
        if not some.all():
            active, at, rest = active[some], at[some], rest[some]
        if not len(active):
            break
        chunk = windows[at].view("<u8")[:, 0] & _HEAD[np.minimum(rest, 8)]
        one[active] = mix(one[active] ^ chunk)
        two[active] = mix(two[active] + chunk * _OTHER)
        at, rest = at + 8, rest - 8
    size = lengths.astype(np.uint64)
    one, two = mix(one + size * _STEP), mix(two ^ size * _BASE)
    for i in np.flatnonzero(lengths > LONG):
        one[i], two[i] = np.frombuffer(xxhash.xxh3_128_digest(piece[starts[i] : starts[i] + lengths[i]].tobytes()), np.uint64)
    return one, two


def tokenise(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word, and n + 1 offsets of each value's first word."""
    data, offsets = utf8(column)
    one, two, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
    at, n = 0, len(offsets) - 1
    while at < n:  # in pieces of about 1 MB; a longer value is a piece of its own
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        piece, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        word = ~_SPACE[piece]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = cuts[1:-1]
        inner = inner[(inner > 0) & (inner < len(piece))]
        begin[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
        starts = np.flatnonzero(begin)
        ones, twos = _digests(piece, starts, np.flatnonzero(end) + 1 - starts)
        one.append(ones)
        two.append(twos)
        counts.append(np.diff(np.searchsorted(starts, cuts)))
        at = to
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two), np.concatenate([[0], np.cumsum(count)])


def _rolled(words: np.ndarray, width: int, base: np.uint64, out: np.ndarray) -> np.ndarray:
    """``out`` with the highest bits of the windows' hashes. They don't depend on where a window stands, so that CHUNK windows
    at once have the hashes that all would have, with tables and steps between of this size alone."""
    shift = np.uint64(64 - 8 * out.itemsize)
    for a in range(0, len(out), CHUNK):
        starts = np.arange(min(CHUNK, len(out) - a))
        out[a : a + CHUNK] = mix(_span_hash(words[a : a + CHUNK + width - 1], base, starts, starts + width)) >> shift
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``words[i : i + width]`` for every i; windows may cross values, see :func:`inside`."""
    return _rolled(words, width, _STEP, np.empty(max(0, len(words) - width + 1), np.uint64))


def second_rolling(others: np.ndarray, width: int) -> np.ndarray:
    """32 bits of a second hash of the same windows, from the words' other hashes and by another base."""
    return _rolled(others, width, _BASE, np.empty(max(0, len(others) - width + 1), np.uint32))


def owner(offsets: np.ndarray) -> np.ndarray:
    """For every word the index of its value."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that starts at each word ends inside the same value (for each i < words - width + 1)."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + width <= ends
