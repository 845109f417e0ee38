"""SentencePiece encoding that keeps source offsets, and decoding.

The text is normalised by longest-prefix replacement through the model's compiled character map (a double-array trie
and a pool of replacements; a model without one maps each character to itself), white space becomes U+2581 and the
dummy prefix is added. Each normalised byte keeps the source byte it came from. The library's ids then give piece
lengths in normalised bytes, so that running sums project every piece to a span of the source. An unknown piece has the
characters between the known ones around it: in the library a run of unknown characters is one piece.

Defined results: a null text is an empty one, encoded as the begin and end ids alone; begin, end and dummy prefix have
empty spans; of several pieces that one source character became, as bytes or by the map, the last has its span and the
others are empty before it; a text whose pieces don't add up to the normalised text has null spans, while its ids and decoded text stand; repeated
rows are encoded each for itself; extra columns are ignored; of ids that the model doesn't have :func:`decode` makes a
null text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁".encode()
#: bytes of texts that a worker has as objects, with their ids, at once
PIECE_BYTES = 1 << 18
_loaded: dict[str, Encoder] = {}


class CharsMap:
    """A compiled character map: little-endian trie size, double-array units, zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if blob else np.zeros(0, np.uint32)
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        if not len(self.units):
            return None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(int(self.units[0]))
        found = None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            u = int(self.units[node])
            if (u & 0x800000FF) != text[i]:
                break
            node ^= offset(u)
            if u >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map, self.prefix, self.squeeze, self.escape = CharsMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kinds = proto.SentencePiece
        self.piece = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.encode() for p in proto.pieces]
        self.length = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.library.unk_id()

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte that it comes from."""
        if not len(self.map.units) and not self.squeeze and self.escape:
            return self._escaped(text)
        units = []  # (source begin, replacement)
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at)
            size = hit[0] if hit else next((n for n, low in ((4, 0xF0), (3, 0xE0), (2, 0xC0)) if text[at] >= low), 1)
            units.append((at, hit[1] if hit else text[at : at + size]))
            at += size
        end = len(text)
        if self.squeeze:  # blanks at both ends go, and all but the first of a run
            while units and not units[0][1].strip(b" "):
                del units[0]
        out, source = bytearray(), []
        blank = SPACE if self.escape else b" "
        if self.prefix and units:
            out += blank
            source += [units[0][0]] * len(blank)
        blank_before = self.squeeze
        for begin, new in units:
            if blank_before:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", blank)
                out += shown
                source += [begin] * len(shown)
                blank_before = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(blank):
                end = source[-len(blank)]
                del out[-len(blank) :], source[-len(blank) :]
        return bytes(out), np.array([*source, end if out else 0], np.int64)

    def _escaped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        body = SPACE + text.replace(b" ", SPACE) if self.prefix and text else text.replace(b" ", SPACE)
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 0x20, len(SPACE), 1)
        begin = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, np.arange(len(raw)))) if len(raw) else raw.astype(np.int64)
        source = np.repeat(begin, width)
        if self.prefix and text:
            source = np.concatenate([np.zeros(len(SPACE), np.int64), source])
        return body, np.append(source, len(raw))

    def spans(self, text: bytes, ids: np.ndarray) -> np.ndarray | None:
        """Source (begin, end) of each id; null where the ids aren't the normalised text's."""
        body, source = self.normalise(text)
        size = self.length[ids]
        if (ids == self.unknown).any():
            size = self._sizes(body, ids)
        if size is None or size.sum() != len(body):
            return None
        end = np.cumsum(size)
        return np.stack([source[end - size], source[end]], axis=1)

    def _sizes(self, body: bytes, ids: np.ndarray) -> np.ndarray | None:
        """Lengths where some pieces are unknown. Runs of known pieces between unknown ones are found one after another;
        where the first of them may begin at several places, the latest pieces decide by going on to the end."""
        runs: list[list[int]] = [[]]
        for k, i in enumerate(ids.tolist()):
            if i == self.unknown:
                runs.append([])
            else:
                runs[-1].append(k)
        show = lambda run: b"".join(self.piece[ids[k]] for k in run)
        texts = [show(r) for r in runs]
        if not body.startswith(texts[0]) or not body.endswith(texts[-1]):
            return None
        known = [0]
        for t in texts[1:-1]:  # at least one character is unknown before each
            at = known[-1] + len(texts[len(known) - 1])
            skip = next((n for n, low in ((4, 0xF0), (3, 0xE0), (2, 0xC0)) if at < len(body) and body[at] >= low), 1)
            found = body.find(t, at + skip) if t else at + skip
            if found < 0:
                return None
            known.append(found)
        if len(texts) > 1:
            known.append(len(body) - len(texts[-1]))
        size = self.length[ids].copy()
        places = iter(zip(known[1:], (a + len(t) for a, t in zip(known, texts, strict=True)), strict=False))
        for k in np.flatnonzero(ids == self.unknown):
            begin, before = next(places)
            size[k] = begin - before
        return size if (size >= 0).all() else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)


def encoder(model: bytes) -> Encoder:
    key = hashlib.sha1(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Encoder(model)
    return _loaded[key]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size > PIECE_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_source_bytes long"


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: str = "digests") -> DataFrame:
    """One row per document: digests of the ids, the decoded text and the source spans; with ``keep="ids"`` also
    ``ids``, and with ``keep="all"`` the text decoded, ``span_begin`` and ``span_end`` too. One pass without a shuffle."""
    kind = dict(docs.dtypes)[id_col]
    more = {"digests": [], "ids": ["ids array<int>"], "all": ["ids array<int>", "span_begin array<long>", "span_end array<long>", "decoded string"]}[keep]
    names = [id_col, *(c.strip().split(" ")[0] for c in SCHEMA.split(",")), *(c.split(" ")[0] for c in more)]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            for a, b in _groups(raw):  # a batch may be a whole partition, of which Arrow's buffers are the only copy
                texts = [(t or b"").decode("utf-8", "replace") for t in raw.slice(a, b - a).to_pylist()]
                all_ids = e.encode(texts)
                decoded = e.library.decode(all_ids)
                rows: list[list] = [[] for _ in names[1:]]
                for text, ids, back in zip(texts, all_ids, decoded, strict=True):
                    x = np.array(ids, np.uint32)
                    span = e.spans(text.encode(), x)
                    shown = None if span is None else hashlib.sha256(span.astype("<u4").tobytes()).hexdigest()
                    values = [len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), shown, len(text.encode())]
                    if more:
                        values += [x.astype(np.int32), *((None, None) if span is None else (span[:, 0], span[:, 1])), back]
                    for column, v in zip(rows, values, strict=False):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, t in zip(rows, types, strict=False))], names=names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {", ".join([SCHEMA, *more])}")


def decode(tokens: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of each row of ids; null ids give an empty text."""
    kind = dict(tokens.dtypes)[id_col]

    def text_of(e: Encoder, ids: list[int] | None) -> str | None:
        fits = all(i is not None and 0 <= i < len(e.length) for i in ids or [])
        return e.library.decode(ids or []) if fits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            texts = [text_of(e, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
