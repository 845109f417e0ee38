"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features are 1-, 2- and 3-grams of the lower-cased text, in which every run of other characters than letters counts as
one space. Each order has its own part of a table of 2**16 slots. Training counts come from every labelled row in one
pass and are summed in Spark. The driver gets one count for each cell of the matrix slots x languages that isn't empty,
and the workers the matrix of smoothed log-probabilities; both are bounded by CELLS, as the table has half as many slots
each time that more than CELLS / slots languages (256 at the full size) would go over it. Every language is learned.
Scoring adds gathered matrix rows by document.

The score is the posterior of the winner from log-likelihoods for each n-gram, tempered by ``EVIDENCE`` n-grams so that
it does not saturate on long texts: in (0, 1].

Defined results: ``und`` with score 0 for a null text or one without letters, or if nothing was learned; of equal
scores the language that sorts first wins; null languages are not learned; a column of more than CELLS / LEAST_SLOTS
(262,144) different labels isn't one of languages and raises ValueError; repeated rows count each; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, LEAST_SLOTS, CELLS = 1 << 16, 1 << 6, 1 << 24
EVIDENCE = 20.0
ALPHA = 0.5
PIECE_CHARS = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x33480)], bool))
    return _letters[0]


def slots_for(languages: int) -> int:
    """The largest table that keeps the matrix within CELLS."""
    slots = SLOTS
    while slots * languages > CELLS:
        slots //= 2
    if slots < LEAST_SLOTS:
        raise ValueError(f"{languages} different labels are no languages")
    return slots


def parts(slots: int) -> tuple[tuple[int, int], ...]:
    """(begin, end) of the table's parts for 1-, 2- and 3-grams."""
    return (0, slots // 16), (slots // 16, slots // 4), (slots // 4, slots)


def pieces(texts: list[str | None], slots: int = SLOTS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, slots of all n-grams, owner of each n-gram counted from ``from``), about PIECE_CHARS at a time."""
    at, size = 0, 0
    for i in range(len(texts)):
        size += len(texts[i] or "")
        if size > PIECE_CHARS or i == len(texts) - 1:
            yield at, i + 1, *_ngrams([(t or "").lower() for t in texts[at : i + 1]], slots)
            at, size = i + 1, 0


def _ngrams(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    joined = " ".join(texts) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    table = letters()
    letter = table[np.minimum(c, len(table) - 1)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a letter, or the one space after a run of letters
    c, owner, letter = c[keep], owner[keep], letter[keep]
    c = np.where(letter, c, 32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    one = c * mul
    two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) * mul + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * mul + c[2:]
    found, owners = [], []
    for order, h in enumerate((one, two * mul, three * mul)):
        same = owner[: len(h)] == owner[order : order + len(h)]
        base, end = parts(slots)[order]
        mixed = h ^ (h >> np.uint64(32))
        found.append((base + (mixed % np.uint64(end - base)).astype(np.int64))[same])
        owners.append(owner[: len(h)][same])
    return np.concatenate(found), np.concatenate(owners)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix (slots x languages) of log-probabilities whose last row holds the priors."""
    labelled = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(CELLS // LEAST_SLOTS + 1).collect()
    rows = sorted((r["lang"], r["n"]) for r in counted)  # one for each language, a bounded number
    langs, slots = [x for x, _ in rows], slots_for(len(rows))
    code_of = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([code_of[x] for x in batch.column(1).to_pylist()], np.int64)
            order = np.argsort(code, kind="stable")
            cuts = np.append(np.unique(code[order], return_index=True)[1], len(code))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # the rows of one language at a time
                total = np.zeros(slots, np.int64)
                for *_, slot, _ in pieces(batch.column(0).take(pa.array(order[a:b])).to_pylist(), slots):
                    total += np.bincount(slot, minlength=slots)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), code[order[a]], np.int32)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["code", "slot", "n"])

    sums = labelled.mapInArrow(count, "code int, slot int, n long").groupBy("code", "slot").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # CELLS rows at most
    counts = np.zeros((slots, len(langs)))
    counts[found["slot"].to_numpy(), found["code"].to_numpy()] = found["n"].to_numpy()
    matrix = np.empty((slots + 1, len(langs)), np.float32)
    for a, b in parts(slots):
        part = counts[a:b] + ALPHA
        matrix[a:b] = np.log(part / part.sum(axis=0))
    prior = np.array([n for _, n in rows], float) + 1
    matrix[slots] = np.log(prior / prior.sum()) if langs else 0
    return langs, matrix


def predict_batch(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(texts))
    slots = len(matrix) - 1
    prior = matrix[slots].astype(float)
    for a, b, slot, owner in pieces(texts, slots):
        n = np.bincount(owner, minlength=b - a)
        sums = np.stack([np.bincount(owner, weights=matrix[slot, k], minlength=b - a) for k in range(len(langs))], axis=1) if langs else np.zeros((b - a, 0))
        if not langs:
            names += ["und"] * (b - a)
            continue
        z = sums + prior
        best = np.argmax(z, axis=1)
        z = (z - z[np.arange(b - a), best][:, None]) * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        names += [langs[k] if m else "und" for k, m in zip(best, n, strict=True)]
        scores[a:b] = np.where(n > 0, 1 / np.exp(z).sum(axis=1), 0.0)
    return names, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``; one pass without a shuffle."""
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)  # CELLS numbers at most
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_batch(batch.column(len(keep)).to_pylist(), langs, sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")
