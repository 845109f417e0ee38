"""The ten operators against brute force on small fixtures with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from webframe.llm import decontamination, language_id, pieces, quality, sharding, simhash, substring_dedup, url_filter
from webframe.llm.queries import QUERIES, tokenizer_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def fixture_rows(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "ünï çödé 漢字  x  y"), (6, "a b c " * 3000)]
    for i in range(7, n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(words)), rng.randint(0, 20)
            words[at:at] = rng.choice(passages)[cut:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(n, rows[10][1]), (n + 1, rows[10][1]), (n + 2, rows[11][1] + " x")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 5 == 0 else "s", 0, "clash") for i, t in rows], DOCS).repartition(3).cache()


def brute_substring(rows):
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(i, least.get(g, i))
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_dedup(docs, rows):
    done = substring_dedup.remove_repeats(docs)
    found = {r["doc_id"]: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in done.collect()}
    assert found == brute_substring(rows)
    assert set(docs.columns) <= set(done.columns)


def brute_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    parent = {i: i for i in marks}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(marks)
    for a in ids:
        for b in ids:
            if a < b and bin(marks[a] ^ marks[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    marks = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(marks)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{marks[i]:016x}", want[i]) for i in marks}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_simhash_links_inside_lists():
    """Short lists by tallies, long ones by look-ups: both connect what brute force connects, to the least member."""
    import numpy as np

    rng = random.Random(3)
    base = rng.getrandbits(64)
    near = {base ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) for _ in range(90)}
    far = near | {base ^ (rng.getrandbits(16) << 16) for _ in range(60)} | {base ^ (1 << rng.randrange(32)) for _ in range(20)}
    for links, marks in ((simhash.looked_up_links, near), (simhash.tallied_links, near), (simhash.tallied_links, far)):
        fp = np.array(sorted(map(signed, marks)), np.int64)
        u, v = links(fp.view(np.uint64))
        joined = {f: f for f in fp.tolist()} | dict(zip(u.view(np.int64).tolist(), v.view(np.int64).tolist(), strict=True))
        assert joined == brute_components({f: f % (1 << 64) for f in fp.tolist()})


def test_simhash_lists_longer_than_are_gathered(spark):
    from webframe.llm.components import components

    rng = random.Random(4)
    base = rng.getrandbits(64)
    marks = {base ^ rng.getrandbits(13) for _ in range(700)} | {base ^ (rng.getrandbits(12) << 40) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(signed(x),) for x in marks], "fp long")
    edges = simhash.postings(df).mapInArrow(simhash._links, "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    want = brute_components({signed(x): x for x in marks})
    assert {x: found.get(x, x) for x in want} == want


def test_simhash_ids_of_any_value(spark):
    texts = {1: "a b c d", 2**62: "e f g h", 2**62 + 5: "e f g h", 2**63 - 1: "i j k l", -5: "a b c d"}
    rows = [*texts.items(), (None, "i j k l"), (None, "m n o p")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert found == sorted([(1, -5), (-5, -5), (2**62, 2**62), (2**62 + 5, 2**62), (2**63 - 1, 2**63 - 1), (None, 2**63 - 1), (None, None)], key=str)


def test_sharding(docs, rows):
    out = sharding.shard(docs, shards=7).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    by_shard = {}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard.get(k, [])) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(5), shards=7).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in out}


def brute_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = {}
    for k in range(len(w) - 4):
        grams.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {k + j for ks in grams.values() if len(ks) > 1 for k in ks for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(docs, rows):
    found = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs).collect()}
    assert found == {i: brute_base(t) for i, t in rows}


def test_quality_lines_across_documents(spark):
    rng = random.Random(1)
    own = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))
    rows = [(i, ("Accept all cookies of this site\n" * 2 + own()) if i < 30 else own(), None, "h", 0, "") for i in range(60)]
    rows += [(100, "\n".join(["ACCEPT  all cookies of this SITE"] + ["x y z " + str(k) for k in range(1)]), None, "h", 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    judged = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.judge(docs).collect()}
    assert all(judged[i][0] for i in range(30, 60))
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, (k, _) in judged.items() if k}
    assert 100 not in kept


def edits_of(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_decontamination(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(k, text(40)) for k in range(6)] + [(90, None), (91, ""), (92, "short")]
    rows = [(0, None), (1, ""), (2, text(200)), (3, text(30) + " " + items[1][1].upper() + " " + text(30))]
    noisy = list(items[2][1][:160])
    for at in range(10, 160, 40):
        noisy[at] = "#"
    rows += [(4, text(10) + " " + "".join(noisy) + " " + text(10)), (5, text(500)), (6, items[3][1]), (6, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(3, 1), (4, 2), (6, 3), (6, 3)]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, bench).collect()) == [0, 1, 2, 5]
    assert edits_of("kitten", "sitting") == 3


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean(docs, none).count() == 1
    assert decontamination.clean(docs.limit(0), none).count() == 0
    assert decontamination.contaminated(docs, none).count() == 0


def test_sentencepiece(docs, rows):
    import sentencepiece

    model = tokenizer_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = rows + []
    found = {r["doc_id"]: r for r in pieces.encode(docs.select("doc_id", "text"), model).collect()}
    for i, t in texts:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()), (i, t[:50] if t else t)


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://b.net": ("b.net", "", None, None),
        "https://b.net/": ("b.net", "/", "net/", "block"),
        "https://fr.org/fr/1": ("fr.org", "/fr/1", "org/fr/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "mailto:x": ("", "", None, None),
        None: ("", "", None, None),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    for i, want in enumerate(cases.values()):
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == want[:3]
        assert r["verdict"] in ("allow", "block") and (want[3] is None or r["verdict"] == want[3])


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    both = found.join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL AND length(text) > 100")
    n, right = both.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.95
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    want = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in docs.select("doc_id").collect()}
    assert {r["doc_id"]: r["held_out"] for r in found.select("doc_id", "held_out").collect()} == want


def test_language_without_letters(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "und die katze")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.train(train)).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "de"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_null_tables(spark, tmp_path, name):
    """All queries over tables without rows, and over tables of rows of nulls."""
    for kind, n in (("empty", 0), ("nulls", 3)):
        folder = str(tmp_path / kind)
        for table in ("documents", "pages", "benchmark", "conversations", "labels"):
            like = spark.read.parquet(f"{DATA}/{table}.parquet")
            cols = [F.lit(None).cast(t).alias(c) for c, t in like.dtypes]
            spark.range(n).select(*cols).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        rows = QUERIES[name](spark, folder).collect()
        if name not in ("op2_decontamination", "op8_chat_formatting", "op13_source_divergence"):  # whose rows are no documents
            assert len(rows) == n
