"""Importance resampling and the audit of sources against plain Python, on fixtures with nulls, ties and odd bytes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from webframe.llm import divergence, resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_features(text, order=3):
    w = WORDS.findall(low(text))
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute_resample(docs, target):
    """{position: (n_features, weight, score, rank)}"""
    made = [brute_features(t) for _, t in docs]
    s, t = Counter(bucket(f) for _, fs in made for f in fs), Counter(bucket(f) for x in target for f in brute_features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for (i, _), (w, fs) in zip(docs, made, strict=True):
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    n = 5 * len(fit) // 100
    return Counter((r[0], r[2], r[3], r[4], k + 1 if k < n else None) for k, r in enumerate(fit)) + Counter((r[0], r[2], r[3], r[4], None) for r in rows if r[1] < 20)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abCDé09漢") for _ in range(rng.randint(1, 4)))
    rows = [(0, None), (None, None), (None, "x " * 40), (1, ""), (2, " .,\t\n"), (3, "One"), (4, "one-two_three"), (5, "\x00a{b|c}`d@e[f"), (6, "y" * 70_000 + " z" * 25), (7, "漢" * 3000)]
    rows += [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for k in range(10, 260)]
    return [*rows, rows[40], rows[40], (2**62, rows[41][1]), (2**62, rows[42][1])]


def test_features_equal_brute_force():
    rng = random.Random(2)
    alphabet = "abXYZ09 ,.\x00-\n\tüÄ漢é_~`{@[:/"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 9, 60, 400]))) for _ in range(400)] + [None, "", "a" * 5000 + " b", "x" * 90 + " " + "y" * 70 + " z"]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.chunked_array([pa.array(texts[:7]), pa.array(texts[7:])])):
        found = [None] * len(texts)
        for a, b, count, bucket_of, owner in resampling.features(column):
            for i in range(a, b):
                found[i] = (int(count[i - a]), sorted(bucket_of[owner == i - a].tolist()))
        assert found == [(len(w), sorted(map(bucket, f))) for w, f in map(brute_features, texts)]


def test_pieces_of_values_and_registers_one_by_one_are_alike(monkeypatch):
    texts = pa.array([" ".join(f"w{i * k % 97}" for i in range(k)) for k in range(60)] + ["long" * 300 + " b c"])
    flat = lambda: [(a, c.tolist(), sorted(zip((o + a).tolist(), b.tolist(), strict=True))) for a, _, c, b, o in resampling.features(texts)]
    whole = flat()
    for name, value in (("PIECE_BYTES", 50), ("FEW", 0), ("FEW", 10**9)):
        monkeypatch.setattr(resampling, name, value)
        assert sum((c for _, c, _ in flat()), []) == sum((c for _, c, _ in whole), [])
        assert sorted(x for *_, p in flat() for x in p) == sorted(x for *_, p in whole for x in p)


def test_resampling_equals_brute_force(spark, docs):
    target = [None, "", "one two three", *(t for i, t in docs[20:30]), docs[25][1]]
    frame = spark.createDataFrame([(i, t, 1, "r", "w") for i, t in docs], "doc_id long, text string, rank int, score string, n_words string").repartition(5)
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, extra string")
    found = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(frame, bench).collect())
    want = brute_resample(docs, target)
    assert found == want
    kept = resampling.drawn(frame, bench)
    assert kept.columns == frame.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_, rank in want.elements() if rank)
    assert {r["score"] for r in kept.collect()} == {"r"}


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(empty, one).count() == 0 and resampling.drawn(empty, one).count() == 0
    assert [tuple(r) for r in resampling.resample(one, empty).select("n_words", "n_features", "rank").collect()] == [(2, 3, None)]


def test_equal_scores_and_repeated_rows_are_all_ranked(spark):
    docs = [(5, "same words " * 12)] * 30 + [(k, "w " * 25) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = resampling.resample(frame, spark.createDataFrame([("same",)], "text string"), share=(1, 2)).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 31))
    order = sorted((r["rank"], -r["score"], r["doc_id"]) for r in found if r["rank"])
    assert [x[1:] for x in order] == sorted(x[1:] for x in order)


def brute_audit(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(low(x) for x in TERMS.findall(text))
        counts[lang, source].update(found)
        held[lang].update(found.keys())
    out = Counter()
    for lang in {g[0] for g in counts}:
        kept = [w for w, d in held[lang].items() if d >= min_docs]
        sources = [g[1] for g in counts if g[0] == lang]
        n = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: {w: share(counts[lang, s][w], n[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(n.values())) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in sources if t != s]
            more = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out[lang, s, part, item, value, k + 1] += 1
    return out


def audit_rows(seed=3, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é漢", *(f"w{chr(97 + k)}x" for k in range(26)), "rare"]
    rows = [(None, None, None), ("", "en", "a"), (None, "fr", "b"), ("...", "fr", "a"), ("1 2 3", "xx", None)]
    for _ in range(n):
        s = rng.randrange(6)
        rows.append((rng.choice([" ", "-", "9"]).join(rng.choice(vocabulary[s : s + 9 + s]) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", f"s{s}", None])))
    return [*rows, rows[-1], rows[-1]]


@pytest.mark.parametrize("min_docs, top", [(30, 50), (3, 4), (10_000, 50)])
def test_audit_equals_brute_force(spark, min_docs, top):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "n", "t") for r in rows], "text string, lang string, source string, value int, n string, term string").repartition(4)
    found = Counter(tuple(r) for r in divergence.audit(docs, min_docs=min_docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute_audit(rows, min_docs, top)


def test_audit_of_many_groups_without_sending_them(spark, monkeypatch):
    rows = audit_rows(seed=4, n=150)
    monkeypatch.setattr(divergence, "SENT_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD", 20)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = Counter(tuple(r) for r in divergence.audit(docs, min_docs=5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute_audit(rows, 5, 50)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    numbers = [(3 * 10**15 + 7, 9 * 10**16 + 1, 12_345), (0, 1, 1), (10**17, 10**17, 3)]
    frame = spark.createDataFrame(numbers, "c long, n long, v long")
    from pyspark.sql import functions as F

    found = [r[0] for r in frame.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert found == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in numbers]


def test_terms_of_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(500)).encode()
    whole = divergence.terms(text)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 7)
    assert divergence.terms(text) == whole == Counter(text.split())
    assert np.sum(list(whole.values())) == 500
