"""SuperMinHash near duplicates against brute force over all pairs, and the laws of the signatures."""

import random
import re

import numpy as np
import pytest

from webframe.llm import near_copies, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 2]) for i in range(len(w) - 1)) if len(w) > 1 else frozenset({tuple(w)} if w else ())


def brute(rows):
    """(id, set size, component, kept) of rows, in order."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [(own, len(sets[i]), least.get(root(i)), own == least.get(root(i))) for i, (own, _) in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "n", "x") for i, t in rows], "doc_id long, text string, node int, key string, component_id string").repartition(5)
    found = [tuple(r) for r in superminhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert ordered(found) == ordered(brute(rows))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(21)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b"), (3, "one"), (4, "ONE"), (5, "one two"), (None, "one two"), (None, None), (6, "Ünï ünï"), (7, "ünï ünï"), (8, "\xa0 a"), (2**62 + 5, "far apart ids"), (2**62 + 1, "Far apart IDS"), (-3, "far  apart\tids")]
    k = 100
    for size in (3, 5, 6, 9, 12, 30, 80, 300):
        for _ in range(6):
            base = [f"v{rng.randrange(5000)}" for _ in range(size)]
            for edits in (0, 0, 1, 2, size // 12, size // 8):
                rows.append((k, rng.choice([" ", "\n", "  "]).join(edited(rng, base, edits))))
                k += 1
    rows += [(None, rows[50][1]), (rows[60][0], rows[60][1]), (rows[60][0], rows[90][1]), (7, rows[50][1]), (k, "long " * 3 + " ".join(f"x{i}" for i in range(20_000))), (k + 1, " ".join(f"x{i}" for i in range(20_050)))]
    rng.shuffle(rows)
    check(spark, rows)


def test_chains_and_large_groups_at_the_threshold(spark):
    words = [f"c{i}" for i in range(400)]
    chain = [(500 - k, " ".join(words[6 * k : 6 * k + 60])) for k in range(40)]  # each shares 53 of 65 shingles with the next
    exact = [(1000, " ".join(f"t{i}" for i in range(10))), (1001, " ".join(f"t{i}" for i in range(9)) + " u v"), (1002, " ".join(f"t{i}" for i in range(9))), (1003, " ".join(f"s{i}" for i in range(6))), (1004, " ".join(f"s{i}" for i in range(5)))]
    rng = random.Random(5)
    base = [f"g{i}" for i in range(120)]
    group = [(2000 + k, " ".join(edited(rng, base, rng.randrange(5)))) for k in range(120)] + [(3000 + k, "copy of one text") for k in range(60)]
    check(spark, [*chain, *exact, *group])


def test_lists_of_several_components(spark, monkeypatch):
    """Sets that share bands without being links, dealt in chunks, with texts sent or not."""
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    monkeypatch.setattr(near_copies, "SENT_KEYS", 0)
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(60)]
    rows = [(k, " ".join(hot + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 12, 16, 60]))])) for k in range(70)]
    check(spark, rows)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert superminhash.near_duplicates(empty).count() == 0
    check(spark, [(1, None), (2, "")])


def test_signatures_are_unbiased_and_below_the_variance_of_minima():
    rng = np.random.default_rng(3)
    for n in (8, 40, 200):
        off = []
        for _ in range(150):
            x = rng.integers(-(2**62), 2**62, n + n // 4)
            a, b = np.unique(x[:n]), np.unique(x[n // 4 :])
            same = superminhash.signatures([a, np.zeros(0, np.int64), b])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append((same[0] == same[2]).mean() - j)
            assert (same[1] == np.uint64(2**64 - 1)).all() and (same[[0, 2]] != np.uint64(2**64 - 1)).all()
        independent = (j * (1 - j) / superminhash.LENGTH) ** 0.5
        assert abs(np.mean(off)) < 0.35 * independent and np.std(off) < independent


def test_signatures_do_not_depend_on_what_is_signed_with_them(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(2**62), 2**62, n)) for n in (1, 2, 3, 500, 0, 40, 7, 3000)]
    whole = superminhash.signatures(sets)
    monkeypatch.setattr(superminhash, "ELEMENTS", 1)
    assert (superminhash.signatures(sets) == whole).all()
    assert superminhash.signatures([]).shape == (0, superminhash.LENGTH)
    merged = superminhash.signatures([np.union1d(sets[3], sets[5])])[0]
    assert (merged == np.minimum(whole[3], whole[5])).all()  # signatures of unions are minima


@pytest.mark.parametrize("similarity", [0.8])
def test_bands_miss_no_similar_sets(similarity):
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = rng.integers(-(2**62), 2**62, 100)
        a, b = np.sort(x[:90]), np.sort(x[10:])
        h = superminhash.bands(superminhash.signatures([a, b]))
        assert (h[0] == h[1]).any()
