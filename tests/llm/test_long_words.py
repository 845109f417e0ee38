"""Substring dedup with words of which a polynomial hash of bytes sees no difference, and with very long ones."""

from test_llm_operators import brute_substring

from webframe.llm import substring_dedup
from webframe.llm.words import tokenise


def thue_morse(bits, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << bits))


def test_long_words_are_told_apart(spark):
    x, y = thue_morse(10, "ab"), thue_morse(10, "ba")
    head = " ".join(f"w{i}" for i in range(12))
    huge = "é" * 200_000
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}"), (4, f"{head} {huge}a"), (5, f"{head} {huge}b"), (6, f"{head} {huge}b"), (7, " ".join([x] * 20 + [y] * 20)), (8, " ".join([x] * 13 + [y] * 13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert found == brute_substring(rows)
    assert (found[2][1], found[3][1], found[5][1], found[6][1]) == (0, 13, 0, 13)


def test_words_have_two_hashes_from_their_bytes():
    import random

    import pyarrow as pa

    rng = random.Random(4)
    words = ["a", "b", "é", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 256, "a" * 257, "\x00", "\x00\x00", "\x00" * 8, "\x00" * 9]
    words += ["".join(rng.choice("ab\x00é") for _ in range(n)) for n in (1, 3, 7, 8, 9, 31, 64, 255, 256, 257, 3000) for _ in range(9)]
    one, two, offsets = tokenise(pa.array([f"{w} {w}\x0b" for w in words] + ["", None]))
    assert offsets.tolist() == [*range(0, 2 * len(words) + 1, 2), 2 * len(words), 2 * len(words)]
    for h in (one, two):
        assert (h[::2] == h[1::2]).all() and len(set(h.tolist())) == len(set(words))
    assert not set(one.tolist()) & set(two.tolist())
    assert [len(x) for x in tokenise(pa.array([], pa.string()))] == [0, 0, 1]
