"""Nulls, repeated ids, clashing names, damaged inputs and second implementations of what the operators compute."""

import gzip
import math
import os
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webframe.llm import decontamination, language_id, warc


def test_warc_of_repeated_and_null_ids_and_clashing_names(spark):
    x, y = "x" * 2000, "y" * 3000
    rows = [(1, x), (1, y), (2, x), (2, x), (None, x), (None, None), (5, "z"), (8, "b" * (1 << 21)), (9, "b" * (1 << 21))]
    pages = spark.createDataFrame([(i, "http://a/", h, "c", "d", 1, "e") for i, h in rows], "page_id long, url string, html string, first string, capture string, nth int, page string")
    folder = warc.archive_folder(spark, "test")
    warc.write(pages, folder)
    read = warc.read(spark, folder).cache()
    assert read.select("id").distinct().count() == read.count() == 3 * len(rows)
    found = Counter((r["k"], r["type"], r["n"], r["held"], r["first"], r["m"], r["ask"]) for r in warc.transactions(read).selectExpr("response.capture_key k", "response.type", "response.payload_length n", "length(response.payload) held", "response.refers_to_key first", "size(metadata) m", "request.type ask").collect())
    want = [("1", "revisit", 2000, 0, "2"), ("1", "response", 3000, 3000, None), ("2", "response", 2000, 2000, None), ("2", "response", 2000, 2000, None), (None, "response", 2000, 2000, None), (None, "response", 0, 0, None), ("5", "response", 1, 1, None), ("8", "revisit", 1 << 21, 0, "9"), ("9", "response", 1 << 21, 1 << 21, None)]
    assert found == Counter((*w, 1, "request") for w in want)


def record(kind, own, block, *fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_chains_of_names_and_damaged_archives(spark, tmp_path):
    to = "WARC-Concurrent-To"
    blob = record("request", "q", b"ask") + record("response", "r", b"answer", (to, "q"))
    later = record("metadata", "m", b"a: b", (to, "r")) + record("metadata", "n", b"", (to, "q"), (to, "r"))
    other = record("metadata", "alone", b"\r\n\r\n", (to, "nobody")) + record("response", "s", b"", (to, "s"))
    for name, data in (("part-0", blob), ("part-1", gzip.compress(later) + gzip.compress(other)), ("part-2", blob.replace(b"<", b"")[:-7]), ("part-3", gzip.compress(other)[:-9]), ("part-4", b"nothing"), ("part-5", b"")):
        with open(tmp_path / name, "wb") as f:
            f.write(data)
    sound = tmp_path / "sound"
    os.makedirs(sound)
    for k in (0, 1):
        os.link(tmp_path / f"part-{k}", sound / f"part-{k}")
    rows = warc.transactions(warc.read(spark, str(sound))).selectExpr("request.id q", "response.id r", "transform(metadata, x -> x.id) m").collect()
    assert sorted((r["q"] or "", r["r"] or "", sorted(r["m"])) for r in rows) == [("", "", ["alone"]), ("", "s", []), ("q", "r", ["m", "n"])]
    assert Counter(r["type"] for r in warc.read(spark, str(tmp_path)).select("type").collect())["damaged"] == 3


def test_decontamination_of_null_and_text_item_ids(spark):
    rng = random.Random(3)
    item = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    items = [("a", item()), (None, item()), (None, item()), ("a", item())]
    docs = spark.createDataFrame([(7, " ".join(t for _, t in items), "x"), (None, items[1][1], "y"), (3, None, "z")], "doc_id long, text string, id string")
    bench = spark.createDataFrame([*items, items[0], ("e", None)], "item_id string, text string")
    found = Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect())
    assert found == Counter({(7, "a"): 2, (7, None): 2, (None, None): 1})
    assert [r["id"] for r in decontamination.clean(docs, bench).collect()] == ["z"]


def brute_edits(window, text):
    """Fewest edits between the window and any part of the text."""
    cost = np.zeros(len(text) + 1, int)
    for x in window:
        step = np.minimum(cost[:-1] + np.array([x != c for c in text], int), cost[1:] + 1)
        new = np.concatenate([[cost[0] + 1], step])
        cost = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(cost.min())


def test_decontamination_equals_brute_force():
    D = decontamination
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(rng.choice([4, 8, 14, 25, 40]))) for k in range(8)]
    texts = []
    for _ in range(90):
        t = D.normal(rng.choice(items)[1])
        a = rng.randint(0, len(t) // 2)
        part = list(t[a : a + rng.randint(40, 140)])
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice(["", "x", part[k] + "y"])
        texts.append(D.normal(f"{say(6)} {''.join(part)} {say(6)}"))
    found = {(t, i): (n, e) for t, i, n, e, _, _ in D.Index(items).search(texts)}
    want = {}
    for i, text in items:
        whole = D.normal(text)
        if len(whole) < D.MIN_CHARS:
            continue
        for s, e in D.spans(len(whole)):
            for t, doc in enumerate(texts):
                edits = brute_edits(whole[s:e], doc)
                if edits <= D.budget(e - s):
                    n, least = want.get((t, i), (0, 99))
                    want[t, i] = n + 1, min(least, edits)
    assert found == want and len(want) > 20


def test_decontamination_of_runs_is_bounded():
    index = decontamination.Index([(1, "_" * 80)])
    (row,) = index.search(["_" * 60_000])
    assert row[:2] == (0, 0) and row[3] == 0
    assert max(len(at) for at, _ in index.stretches(*index.shared(decontamination._chars("_" * 60_000)))) < 10_000


def brute_bayes(train, text):
    """Dicts over the hashed slots of one language at a time."""
    slots = language_id.slots_for(len({x for _, x in train}))
    features = lambda t: [int(s) for *_, slot, _ in language_id.pieces([t], slots) for s in slot]
    scores = {}
    for lang in sorted({x for _, x in train}):
        count = Counter(s for t, x in train if x == lang for s in features(t))
        score = math.log((sum(x == lang for _, x in train) + 1) / (len(train) + len({x for _, x in train})))
        for a, b in language_id.parts(slots):
            total = sum(n for s, n in count.items() if a <= s < b) + language_id.ALPHA * (b - a)
            score += sum(math.log((count[s] + language_id.ALPHA) / total) for s in features(text) if a <= s < b)
        scores[lang] = score
    best = max(scores, key=lambda x: (scores[x], [-ord(c) for c in x]))
    n = max(1, len(features(text)))
    return best, 1 / sum(math.exp((s - scores[best]) * min(1, language_id.EVIDENCE / n)) for s in scores.values())


def test_language_equals_a_naive_bayes_of_dicts(spark):
    rng = random.Random(2)
    words = {"x": "alpha beta gamma delta", "y": "beta delta épsilon zêta", "z": "ωμέγα alpha 漢字 delta"}
    say = lambda x: " ".join(rng.choice(words[x].split()) for _ in range(rng.randint(1, 6)))
    train = [(say(x), x) for x in "xxyyyz" for _ in range(4)]
    df = spark.createDataFrame([*[(t, x, "k") for t, x in train], (None, "x", "k"), ("a", None, "k")], "text string, lang string, code string").repartition(3)
    texts = [say(rng.choice("xyz")) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    for r in language_id.predict(docs, language_id.train(df)).collect():
        lang, score = brute_bayes(train, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_every_language_is_learned(spark):
    assert [language_id.slots_for(n) for n in (0, 256, 257, 8000)] == [1 << 16, 1 << 16, 1 << 15, 1 << 11]
    with pytest.raises(ValueError):
        language_id.slots_for(1 << 19)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    df = spark.createDataFrame([(f"{name(i)} {name(i)}", f"l{i}") for i in range(400)], "text string, lang string")
    found = language_id.predict(df.withColumnRenamed("lang", "doc_id"), language_id.train(df)).collect()
    assert sum(r["doc_id"] == r["lang_pred"] for r in found) == 400


def brute_repeats(rows):
    """{row number: (words, removed, kept)}; rows without an id neither lose nor give."""
    least = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12 if i is not None else 0):
            g = tuple(w[k : k + 13])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 12 if i is not None else 0) if least[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_repeats_across_and_inside_batches_with_odd_ids(spark):
    from webframe.llm import substring_dedup

    rng = random.Random(21)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    passages = [say(n) for n in (12, 13, 14, 20, 60)]
    ids = [None, 7, 7, 7, -3, 2**63 - 1, -(2**63), *range(100, 260)]
    rows = []
    for i in ids:
        w = say(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(passages)[rng.randint(0, 3) :]
        rows.append((i, " ".join(w)))
    rows += [(300, rows[9][1]), (300, rows[9][1]), (7, rows[1][1]), (None, rows[20][1]), (301, None), (302, ""), (303, " ".join(rows[30][1].split() * 40))]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, __kept string, batch string, keys string, __meta string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            done = substring_dedup.remove_repeats(df.repartition(3), names=("n", "gone", "left")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert Counter((r["doc_id"], r["n"], r["gone"], r["left"]) for r in done) == Counter(brute_repeats(rows))
        assert {(r["__kept"], r["batch"], r["keys"], r["__meta"]) for r in done} == {("a", "b", "c", "d")}
    replaced = substring_dedup.remove_repeats(df)
    assert replaced.columns == ["doc_id", "text", "batch", "keys", "__meta", "__n_words", "__n_removed", "__kept"]


def brute_fits(x, schema):
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None), "object": dict, "array": list}
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any(isinstance(x, kinds[t]) and (t == "boolean" or not isinstance(x, bool)) for t in types):
        return False
    if "enum" in schema and x not in schema["enum"]:
        return False
    sizes = {"Length": len(x) if isinstance(x, str) else None, "Items": len(x) if isinstance(x, list) else None, "imum": x if isinstance(x, (int, float)) and not isinstance(x, bool) else None}
    for name, size in sizes.items():
        if size is not None and not schema.get(f"min{name}", size) <= size <= schema.get(f"max{name}", size):
            return False
    if isinstance(x, list) and "items" in schema and not all(brute_fits(y, schema["items"]) for y in x):
        return False
    if isinstance(x, dict) and ("properties" in schema or "required" in schema):
        known = schema.get("properties", {})
        if not schema.get("additionalProperties") and not set(x) <= set(known) or not set(schema.get("required", ())) <= set(x):
            return False
        return all(brute_fits(y, known[k]) for k, y in x.items() if k in known)
    return True


def test_schemas_of_nested_arguments(spark):
    import json

    from webframe.llm import chat

    schema = {
        "type": "object",
        "properties": {
            "to": {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string", "minLength": 2}, "age": {"type": ["integer", "null"], "minimum": 0}}, "required": ["name"]}, "minItems": 1, "maxItems": 2},
            "mode": {"enum": ["a", "b", 3, None]},
            "rate.x": {"type": "number", "maximum": 1.5},
            "any": {},
            "open": {"type": "object", "required": ["k"], "additionalProperties": True},
        },
        "required": ["to"],
    }
    rng = random.Random(6)
    pick = lambda *xs: rng.choice(xs)

    def person():
        return pick({"name": pick("ann", "x", 5)}, {"name": "bob", "age": pick(3, -1, None, "4", 2.5)}, {"age": 1}, {"name": "bob", "more": 1}, "bob")

    rows = []
    for _ in range(300):
        x = {"to": pick([], [person()], [{"name": "ann"}], [{"name": "ann"}, person()], [person()] * 3, "no", None)}
        for k, v in (("mode", pick("a", "c", 3, None, "3")), ("rate.x", pick(1, 1.5, 2, "1")), ("any", pick([], {}, None, 1)), ("open", pick({"k": 1, "z": 2}, {}, [])), ("z", 1)):
            if rng.random() < 0.2:
                x[k] = v
        rows.append(json.dumps(x))
    whole = [(t, brute_fits(json.loads(t), schema)) for t in rows]
    odd = [("[1]", False), ("{", False), (None, False), ("", False), ("3", False), ('"to"', False)]
    df = spark.createDataFrame([(t, w) for t, w in [*whole, *odd]], "arguments string, want boolean")
    found = df.select("arguments", "want", chat.valid_arguments(F.lit("t"), F.col("arguments"), {"t": schema}).alias("found")).collect()
    assert not [r for r in found if r["found"] != r["want"]]
    assert 10 < sum(w for _, w in whole) < 280
    assert not df.filter(chat.valid_arguments(F.lit("other"), F.col("arguments"), {"t": schema})).count()


def test_order_over_call_dependencies(spark):
    from webframe.llm import chat

    rng = random.Random(5)
    messages, parent = [], {}
    for conv in range(6):
        turns = sorted(rng.sample(range(60), 40))
        for n, t in enumerate(turns):
            after = f"k{rng.choice(turns[:n])}" if n and rng.random() < 0.5 else None
            parent[conv, t] = int(after[1:]) if after else t - 1 if t - 1 in turns else None
            messages.append((conv, t, "call", f"k{t}", after, "reply", "{}", None, None))
    circle = [(90, t, "call", f"k{t}", f"k{(t + 1) % 3}", "reply", "{}", None, None) for t in range(3)] + [(90, 9, "call", "k9", "k2", "reply", "{}", None, None), (90, 20, "call", "k20", "nowhere", "reply", "{}", None, None)]
    cols = "conv_id long, turn long, kind string, call_key string, after_key string, name string, arguments string, role string, content string"
    found = {(r["conv_id"], r["turn"]): r["depth"] for r in chat.link(spark.createDataFrame(messages + circle, cols)).collect()}

    def depth(conv, t):
        up = parent[conv, t]
        return 0 if up is None else 1 + depth(conv, up)

    want = {k: depth(*k) for k in parent} | {(90, t): None for t in (0, 1, 2, 9)} | {(90, 20): 0}
    assert found == want
    plain = chat.link(spark.createDataFrame([m[:4] + (None,) + m[5:] for m in messages], cols)).collect()
    turns = {(r["conv_id"], r["turn"]) for r in plain}

    def run(conv, t):
        return 1 + run(conv, t - 1) if (conv, t - 1) in turns else 0

    assert {(r["conv_id"], r["turn"]): r["depth"] for r in plain} == {k: run(*k) for k in turns}


def plain_feistel(x, n, seed):
    """The permutation by integers and the standard hash, walking until inside."""
    import xxhash

    from webframe.llm import sharding

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)

    def mixed(value, k):
        h = 42
        for part in (struct.pack("<i", seed), struct.pack("<i", k), struct.pack("<q", value)):
            h = xxhash.xxh64_intdigest(part, h)
        return signed(h)

    while True:
        left, right = divmod(x, b)
        for k in range(sharding.ROUNDS):
            if k % 2 == 0:
                left = (left + mixed(right, k) % a) % a
            else:
                right = (right + mixed(left, k) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("walks", [64, 1])
def test_feistel_equals_a_second_implementation(spark, monkeypatch, walks):
    from webframe.llm import sharding

    monkeypatch.setattr(sharding, "WALKS", walks)  # with one step for each look, rows must walk on
    for n in (1, 2, 3, 7, 50, 131):
        rows = sharding.permuted(spark.range(n), "id", n, "place", 17).collect()
        assert {r["id"]: r["place"] for r in rows} == {x: plain_feistel(x, n, 17) for x in range(n)}
        assert sorted(r["place"] for r in rows) == list(range(n))


def test_sharding_of_null_ids_ties_and_clashing_names(spark):
    import zlib

    from webframe.llm import sharding

    rows = [(None, "a"), (None, "a"), (None, None), (4, "b"), (4, "b"), (4, "ü"), (2**63 - 1, "")] * 3
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, size int, shard int, _key string")
    found = sharding.shard(df, shards=4).collect()
    body = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len(body(t)) + 16, zlib.crc32(body(t))) for i, t in rows)
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted((k % 4, k // 4) for k in range(len(rows)))


def model_with_map(rule, squeeze, fallback):
    """The query's vocabulary behind a character map that the library compiles from its rules; nothing is trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from webframe.llm.queries import tokenizer_model

    own, rules = pb.ModelProto(), pb.ModelProto()
    own.ParseFromString(tokenizer_model())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    own.normalizer_spec.CopyFrom(rules.normalizer_spec)
    own.normalizer_spec.remove_extra_whitespaces = squeeze
    own.normalizer_spec.add_dummy_prefix = own.normalizer_spec.escape_whitespaces = True
    if not fallback:
        own.trainer_spec.byte_fallback = False
        for p in own.pieces:
            if p.type == p.BYTE:
                p.type = p.CONTROL
    return own.SerializeToString()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_spans_equal_the_librarys_offsets(rule, squeeze, fallback):
    from webframe.llm.pieces import Encoder

    e = Encoder(model_with_map(rule, squeeze, fallback))
    assert bool(len(e.map.units)) == (rule != "identity")
    rng = random.Random(1)
    parts = ["a", "B", "ﬁ", "①", "  ", " ", "\u3000", "é", "e\u0301", "カ\u3099", "が", "\xa0", "漢", "ﷺ", "x", "\n", "\t", "\u200b", "İ", "ß", "😀", "Ⅷ", "ａ", "word", "ing ", "▁"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        raw = text.encode()
        body, source = e.normalise(raw)
        assert body.decode() == e.library.normalize(text), repr(text)
        ids = e.encode([text])[0]
        found = e.spans(raw, np.array(ids))
        want = [(p.begin, p.end) for p in e.library.encode(text, return_type="proto").pieces]
        assert [tuple(map(int, x)) for x in found[1:-1]] == want, repr(text)


def test_spans_and_decoding_of_what_does_not_fit(spark):
    from webframe.llm import pieces
    from webframe.llm.queries import tokenizer_model

    e = pieces.encoder(tokenizer_model())
    ids = np.array(e.encode(["some text"])[0])
    assert e.spans(b"another text of more words", ids) is None
    assert e.spans(b"some text", np.array([e.unknown, *ids, e.unknown])) is None
    rows = spark.createDataFrame([(1, ids.tolist()), (2, None), (3, [5, 10**6]), (4, [-1]), (5, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(rows, tokenizer_model()).collect()} == {1: "some text", 2: "", 3: None, 4: None, 5: ""}


def dict_model(texts):
    """Counts of (context, byte) for every order, by the bytes themselves."""
    from webframe.llm import url_filter as U

    seen, total = Counter(), Counter()
    for t in texts:
        padded = b"\0" * U.ORDER + t
        for i in range(U.ORDER, len(padded)):
            for k in range(U.ORDER + 1):
                seen[padded[i - k : i], padded[i], k] += 1
                total[padded[i - k : i], k] += 1

    def log(t):
        padded, out = b"\0" * U.ORDER + t, 0.0
        for i in range(U.ORDER, len(padded)):
            p = 1 / 256
            for k in range(U.ORDER + 1):
                p = (seen[padded[i - k : i], padded[i], k] + U.SMOOTH * p) / (total[padded[i - k : i], k] + U.SMOOTH)
            out += math.log(p)
        return out

    return log


def test_url_scores_equal_a_model_of_dicts(monkeypatch):
    from webframe.llm import url_filter as U

    monkeypatch.setattr(U, "TABLE_BITS", 23)  # hardly any chance collision
    rng = random.Random(3)
    url = lambda x: f"www.{rng.choice(['news', 'blog', 'shop'])}.{x}/{''.join(rng.choice('abcdef0123') for _ in range(rng.randint(0, 12)))}/{rng.choice(['a', 'ü', '%20'])}"
    good, bad = [url("org").encode() for _ in range(40)], [url("net").encode() for _ in range(30)]
    ratio = U.fit(good, bad)
    yes, no = (dict_model([t for i, t in enumerate(x) if i % 5]) for x in (good, bad))
    texts = [*good[:8], *bad[:8], b"", b"x", b"q" * 300]
    off = [abs(s - (yes(t) - no(t)) / max(1, len(t))) for t, s in zip(texts, ratio.score(texts), strict=True)]
    assert sorted(off)[len(off) // 2] < 1e-5 and max(off) < 0.02
    assert ratio.balance > 0.9
    assert U.fit([], bad).score([b"x"])[0] != 0 and U.fit([], []).score([b"x"])[0] == 0 and U.fit(good[:4], bad).balance is None


def test_url_verdicts_of_long_null_and_repeated_urls(spark):
    from webframe.llm import url_filter as U

    rows = [(k, f"http://h{k}.{'net' if k % 2 else 'org/fr'}/p{k}") for k in range(60)] + [(100, None), (None, "no scheme"), (101, "http://zz.example/" + "long/" * 400_000), (102, "http://zz.example/x"), (102, "http://zz.example/x"), (103, "HTTP://ÜBER.Example.NET/en/\nx")]
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in rows], "page_id long, url string, host string, rule_verdict string")
    found = U.judge(pages).collect()
    assert Counter(r["page_id"] for r in found) == Counter(i for i, _ in rows)
    by = {r["page_id"]: r for r in found}
    assert all(by[k]["verdict"] == ("block" if k % 2 else "allow") for k in range(60))
    assert (by[100]["host"], by[100]["score"], by[None]["path"]) == ("", 0.0, "") and len(by[101]["path"]) == 2_000_001
    assert (by[103]["host"], by[103]["rule"]) == ("ÜBER.example.net".replace("B", "b").replace("E", "e").replace("R", "r"), "example.net/en/")
    assert len({(r["verdict"], r["score"]) for r in found if r["page_id"] == 102}) == 1


def test_near_copies_in_lists_longer_than_a_chunk(spark, monkeypatch):
    from test_whole_jobs import brute_near_copies

    from webframe.llm import near_copies

    monkeypatch.setattr(near_copies, "CHUNK", 4)
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(40)]
    rows = []
    for k in range(60):
        w = hot + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 12, 60]))]
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in near_copies.groups(docs).collect():
        found.setdefault(r["__group"], []).append(r["doc_id"])
    assert sorted(min(v) for v in found.values()) == [rows[k][0] for k in brute_near_copies(rows)]


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, empty tables, very long texts and clashing names, for each stage by itself."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, "x " * 40), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, None), (1, None), (None, None), (2, ""), (None, own(1)), (None, own(1)), (3, own(2)), (3, own(2)), (3, own(3)), (4, own(2)), (2**63 - 1, own(4)), (2**63 - 1, own(5)), (5, " ".join(f"v{j}" for j in range(60_000)))]
    cols = "doc_id long, text string, lang string, source string, n_chars long, l_key long, f_host string, __key string, kept string, component string, id string"
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "a", "b", "c", "d", "e") for i, t in rows], cols).repartition(3)
    want = {
        "quality_rules": Counter((i, t) for i, t in rows if t),
        "near_dedup": Counter([(None, None), (None, own(1)), (None, own(1)), (1, None), (3, own(2)), (3, own(3)), (2**63 - 1, own(4)), (2**63 - 1, own(5)), rows[-1]]),
        "substring_dedup": Counter((i, t) for i, t in rows if i != 4),
        "benchmark_decontamination": Counter(rows),
    }
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        # of the rows that say nothing, ids 1 and 2 are copies of one another
        assert Counter((r["doc_id"], r["text"]) for r in found) == want[name], name
        assert {(r["l_key"], r["f_host"], r["__key"], r["kept"], r["component"], r["id"]) for r in found} == {(1, "a", "b", "c", "d", "e")}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_url_models_count_every_labelled_url_wherever_it_lies(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from webframe.llm import url_filter as U

    ruled = spark.range(60_000).select(
        F.concat(F.lit("h"), F.col("id") % 997, F.when(F.col("id") % 3 == 0, ".net").otherwise(".org")).alias("host"), F.concat(F.lit("/fr/"), F.col("id") % 50_500).alias("path"),
        F.when(F.col("id") % 3 == 0, "block").otherwise("allow").alias("rule_verdict"),
    )
    ruled = ruled.unionByName(ruled.limit(500)).unionByName(spark.range(3).select(F.lit("x").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule_verdict")))
    urls = ruled.filter("rule_verdict IS NOT NULL").select("rule_verdict", F.concat("host", "path").alias("u")).distinct()
    rows = urls.select("rule_verdict", "u", (F.pmod(F.xxhash64("u"), F.lit(U.HELD)) == 0).alias("held")).collect()
    ratio = U.train(ruled)
    for says, model in (("allow", ratio.accepted), ("block", ratio.rejected)):
        want = U.Model.fit([r["u"].encode() for r in rows if r["rule_verdict"] == says and not r["held"]])
        assert np.array_equal(model.seen, want.seen) and np.array_equal(model.total, want.total)
    again = U.train(ruled.repartition(7))
    assert (again.threshold, again.balance) == (ratio.threshold, ratio.balance) and np.array_equal(again.accepted.seen, ratio.accepted.seen)


def test_url_threshold_is_the_best_of_all_cuts(spark):
    from webframe.llm import url_filter as U

    rng = random.Random(4)
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        counts = {rng.choice([-1, 1]) * k / 64: (rng.randrange(4), rng.randrange(1, 4)) for k in range(200)}
        scores = sorted(counts)
        goods, bads = (sum(x[k] for x in counts.values()) for k in (0, 1))
        cut_at = lambda k: (1 - sum(counts[s][0] for s in scores[:k]) / goods) + sum(counts[s][1] for s in scores[:k]) / bads
        k = max(range(len(scores)), key=lambda k: (round(cut_at(k), 12), -k))
        threshold, balance = U.calibrated(spark.createDataFrame([(s, *counts[s]) for s in scores], "score double, good long, bad long"))
        assert threshold == (scores[max(0, k - 1)] + scores[k]) / 2 and abs(balance - cut_at(k) / 2) < 1e-12
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert U.calibrated(spark.createDataFrame([(1.0, 3, 0)], "score double, good long, bad long")) == (0.0, None)
