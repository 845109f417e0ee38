"""Cases in which an operator once did less than its whole job, against brute force."""

import json
import random
import re
from collections import Counter


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def brute_near_copies(rows):
    """Indices of the rows that stay: the first by id in each component."""
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = part[i], part[j]
                part = [b if x == a else x for x in part]
    stay = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        stay.setdefault(part[i], i)
    return sorted(stay.values())


def near_rows(seed=11):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    hot = [f"h{i}" for i in range(12)]
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        if k % 2:
            text[5:5] = hot
        rows.append((len(rows), " ".join(text)))
        for edits in range(rng.randint(0, 4)):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_copies_of_the_pipeline(spark):
    import corpus_pipeline as P

    rows = near_rows()
    rows += [(3, "an own text under a repeated id that nothing else resembles at all")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs.repartition(3), "").collect())
    want = [rows[i] for i in brute_near_copies(rows)]
    assert found == sorted(want) and len(want) < len(rows) - 30


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def norm(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))


def brute_lines(rows, min_docs, share, keep=0.5):
    """(id, text, source) of the rows that stay, without their frequent lines; base rules are taken as passed."""
    held, texts, out = {}, {}, []
    for i, text, host in rows:
        texts.setdefault(host, set()).add(text)
        for line in text.split("\n"):
            held.setdefault((host, norm(line)), set()).add(text)
    for i, text, host in rows:
        often = lambda x: norm(x) and min_docs <= len(held[host, norm(x)]) > share * len(texts[host])  # noqa: B023, E731
        lines = text.split("\n")
        words = [len(norm(x).split()) for x in lines]
        if sum(words) - sum(n for n, x in zip(words, lines) if often(x)) >= keep * sum(words):
            out.append((i, "\n".join(x for x in lines if not often(x)), host))
    return out


def line_rows(seed=2):
    rng = random.Random(seed)
    own = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(90):
        host = None if i % 3 == 0 else "h"
        lines = [own(12), "", own(rng.randint(1, 9))]
        if i % 2:
            lines.insert(rng.randint(0, 3), rng.choice(["Accept all  cookies", "ACCEPT all cookies\t", " accept all cookies"]))
        if i % 10 == 5:
            lines.append("Accept all cookies\n" * 30)
        rows.append((i, "\n".join(lines), host))
    return [*rows, rows[1], rows[3]]


def test_boilerplate_lines_leave_kept_texts(spark):
    import corpus_pipeline as P
    from webframe.llm import quality

    rows = line_rows()
    docs = spark.createDataFrame([(i, t, None, h, -1) for i, t, h in rows], DOCS).repartition(3)
    want = brute_lines(rows, 6, 0.0)
    found = quality.remove_lines(docs, min_docs=6, share=0.0).collect()
    assert sorted((r["doc_id"], r["text"], r["source"] or "") for r in found) == sorted((i, t, h or "") for i, t, h in want)
    assert len(want) < len(rows) and {i: t for i, t, _ in want} != {i: t for i, t, _ in rows}
    staged = P.quality_rules(spark, docs, "").collect()
    assert not [r for r in staged if r["source"] == "h" and "cookies" in r["text"].lower()]
    assert all(r["n_chars"] in (-1, len(r["text"])) for r in staged) and any(r["n_chars"] > 0 for r in staged)


def test_decontamination_of_excerpts_at_every_offset(spark):
    from webframe.llm import decontamination as D

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = text(60)
    long = D.CLOSE_WINDOW + D.CLOSE_STRIDE - 1
    rows = [(k, text(20) + " x" + item[k : k + long] + "x " + text(20)) for k in range(len(item) - long + 1)]
    clear = [(10**6 + k, text(60)) for k in range(50)]
    docs = spark.createDataFrame(rows + clear, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.contaminated(docs, bench).collect()) == [i for i, _ in rows]
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [i for i, _ in clear]


def test_decontamination_of_short_items(spark):
    from webframe.llm import decontamination as D

    bench = spark.createDataFrame([(1, "What is  2+2?"), (2, "Paris"), (3, "???"), (4, "(a b)"), (5, "a question of 23 chars.")], "item_id long, text string")
    rows = [(1, "so: what IS 2+2?"), (2, "comparison"), (3, "in Paris."), (4, "what? ???"), (5, "x(a b)y"), (6, "a b"), (7, "parisian"), (8, "oh, a question of 23 chars. Paris")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["n_windows"], r["edits"]) for r in D.contaminated(docs, bench).collect())
    assert found == [(1, 1, 1, 0), (3, 2, 1, 0), (5, 4, 1, 0), (8, 2, 1, 0), (8, 5, 1, 0)]


def brute_links(messages):
    """(call_id, arguments, result, n_calls, n_results, status) of every different call and result."""
    calls, results = {}, {}
    for conv, kind, key, arguments, content in messages:
        at = (calls if kind == "call" else results).setdefault((conv, key), Counter())
        at[arguments if kind == "call" else content] += 1
    out = []
    for at in calls.keys() | results.keys():
        c, r = calls.get(at, Counter()), results.get(at, Counter())
        rows = [(x, min(r, default=None)) for x in c] + [(min(c, default=None), y) for y in r if not c or y != min(r)]
        out += [(f"{at[0]}:{at[1]}", x, y, c[x], r[y], "orphan_result" if not c else "linked" if r else "unanswered") for x, y in rows]
    return out


def test_every_different_call_and_result_stays(spark):
    from webframe.llm import chat

    rng = random.Random(8)
    messages = []
    for k in range(300):
        hot = k % 3 == 0
        kind = rng.choice(["call", "result"])
        key = "hot" if hot else f"{rng.randrange(40)}{rng.choice('ab')}"
        text = f"t{rng.randrange(20)}"
        messages.append((1 if hot else k % 4, kind, key, f'{{"text":"{text}"}}' if kind == "call" else None, text if kind == "result" else None))
    cols = "conv_id long, kind string, call_key string, arguments string, content string, turn long, call_turn long, name string, role string"
    df = spark.createDataFrame([(*m, k // 2, 0, "reply" if m[1] == "call" else None, None) for k, m in enumerate(messages)], cols)
    found = []
    for r in chat.link(df.repartition(3)).collect():
        j = json.loads(r["json"])
        found.append((r["call_id"], json.dumps(j["arguments"], separators=(",", ":")) if "arguments" in j else None, j.get("result"), r["n_calls"], r["n_results"], r["status"]))
    want = brute_links(messages)
    assert Counter(found) == Counter(want) and len(want) > len({w[0] for w in want}) + 30
    # identifiers that are turns: two results of one turn's call
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    rows = chat.link(chat.turns_as_messages(turns)).collect()
    assert sorted((json.loads(r["json"])["arguments"]["lines"][0], json.loads(r["json"])["result"], r["n_calls"], r["n_results"]) for r in rows) == [("a", "x", 1, 1), ("a", "y", 1, 2), ("b", "x", 1, 1)]


def test_boilerplate_is_found_at_any_host_size(spark):
    from webframe.llm import quality

    own = lambda k: " ".join(f"o{k}x{j}" for j in range(20))
    rows = [(h * 10**4 + k, own(h * 10**4 + k) + ("\nshare this page" if k < 5 else "\nonly four" if k < 9 else "")) for h, n in enumerate((9, 60, 1200)) for k in range(n)]
    docs = spark.createDataFrame([(i, t, None, f"h{i // 10**4}", 0) for i, t in rows], DOCS)
    found = {r["doc_id"] for r in quality.judge(docs).filter("n_boilerplate_words = 3").collect()}
    assert found == {i for i, t in rows if "share" in t}
    assert quality.judge(docs).filter("n_boilerplate_words NOT IN (0, 3)").count() == 0


def brute_passages(rows):
    """Rows without the 13-word passages that a row of a smaller id has; emptied rows go."""
    least, out = {}, []
    grams = lambda w: [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
    for i, t, *_ in rows:
        for g in grams(t.split()):
            least[g] = min(i, least.get(g, i))
    for i, t, n in rows:
        w = t.split()
        gone = {k + j for k, g in enumerate(grams(w)) if least[g] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        if len(gone) < len(w) or not w:
            out.append((i, kept, len(kept)) if gone else (i, t, n))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage, item = own(30), " ".join(own(25))
    rows = []
    for k in range(80):
        w = own(rng.randint(40, 90))
        if k % 8 == 1:
            w[9:9] = passage
        if k % 8 == 2:
            w[7:7] = item.split()[3:18]
        rows.append((k, " ".join(w) + ("\nshare this page" if k % 4 == 3 else "")))
        if k % 5 == 0:
            w[20] = "changed"
            rows.append((1000 + k, " ".join(w)))
    rows += [(5, " ".join(own(50))), (6, rows[6][1]), (2000, "too short"), (2001, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "h", -1) for i, t in rows], DOCS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(i, t, -1 if (i, t) in rows else len(t)) for i, t, _ in brute_lines([(i, t, "h") for i, t in rows], 5, 0.0) if len(t.split()) >= 10]
    want = [want[k] for k in brute_near_copies(want)]
    want = brute_passages(want)
    planted = {i for i, t, _ in want if " ".join(item.split()[3:18]) in t}
    want = [r for r in want if r[0] not in planted]
    found = docs.repartition(3)
    for _, stage in P.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path)).checkpoint()
    assert sorted(map(tuple, found.collect())) == sorted((i, t, "en", "h", n) for i, t, n in want)
    assert planted and sum(i == 5 for i, *_ in want) == 2


def test_near_copies_send_few_texts_to_python(spark):
    import corpus_pipeline as P

    from webframe.llm import near_copies
    from webframe.session import batches_of

    count = lambda batches: (b.select([]).from_pydict({"n": [b.num_rows]}) for b in batches)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with batches_of(spark, 7):
        assert max(r["n"] for r in spark.range(100).mapInArrow(count, "n long").collect()) == 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before and near_copies.ROWS <= 1_000
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in near_rows()], DOCS)
    assert "InArrow" not in P.near_dedup(spark, docs, "")._jdf.queryExecution().executedPlan().toString()


def test_simhash_finds_candidates_of_the_pipeline(spark, monkeypatch):
    """Without the exact lists, what SimHash links and the sets confirm still goes."""
    import corpus_pipeline as P

    from webframe.llm import near_copies

    none = lambda *a: spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(near_copies, "_first_candidates", none)
    monkeypatch.setattr(near_copies, "_other_candidates", none)
    rng = random.Random(8)
    rows = []
    for k in range(30):
        text = [f"w{rng.randrange(900)}" for _ in range(300)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:-1], "other"]))]
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    marks = [near_copies.fingerprint(s) & (2**64 - 1) for s in sets]
    want = {(max(a, b), min(a, b)) for i, a in enumerate(marks) for b in marks[:i] if a != b and (a ^ b).bit_count() <= 2}
    found = near_copies.simhash_candidates(spark.createDataFrame([(k, m - (m >> 63 << 64)) for k, m in enumerate(marks)], "key long, fp long"), 3).collect()
    assert want and want <= {(max(marks[r["u"]], marks[r["v"]]), min(marks[r["u"]], marks[r["v"]])) for r in found}
    assert all((marks[r["u"]] ^ marks[r["v"]]).bit_count() <= 2 for r in found)
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], DOCS)
    stay = {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()}
    assert stay == {i for i, _ in rows} - {2 * k + 1 for k in range(30) if (marks[2 * k] ^ marks[2 * k + 1]).bit_count() <= 2} and len(stay) < 55


class Captured:
    """A frame of two columns that hands over the function which Python workers run on its batches."""

    columns = ["doc_id", "text"]
    dtypes = [("doc_id", "bigint"), ("text", "string")]
    schema = None

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def peak_mb(run, batch):
    """Rows out, and the peak of what Python and numpy allocate meanwhile."""
    import tracemalloc

    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def large_batch(rows=8_000, words=400):
    import pyarrow as pa

    rng = random.Random(5)
    known = [f"word{i}" for i in range(5_000)]
    texts = [None if i % 1000 == 7 else " ".join(rng.choices(known, k=words)) for i in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_workers_hold_no_whole_batch_as_objects(spark):
    """Arrow's batches have up to 10,000 texts: of 27 MB here, as objects and in copies several times that."""
    from webframe.llm import decontamination, pieces
    from webframe.llm.queries import tokenizer_model

    batch = large_batch()
    assert batch.nbytes > 25e6
    encoded = Captured(spark)
    pieces.encode(encoded, tokenizer_model(), keep="ids")
    list(encoded.run(iter([batch.slice(0, 1)])))  # the model is loaded
    rows, mb = peak_mb(encoded.run, batch)
    assert rows == batch.num_rows and mb < 22, mb
    cleaned = Captured(spark)
    text = batch.column(1)[4_321].as_py()
    decontamination.clean(cleaned, spark.createDataFrame([(1, text[100:400])], "item_id int, text string"))
    list(cleaned.run(iter([batch.slice(0, 1)])))
    rows, mb = peak_mb(cleaned.run, batch)
    assert rows == batch.num_rows - 1 and mb < 32, mb


def test_hashes_of_windows_need_no_tables_of_all_words():
    import numpy as np

    from webframe.llm import words

    words._powers.clear()
    x = np.random.default_rng(3).integers(0, 2**64, 300_000, dtype=np.uint64)
    for width in (7, 13):
        one, two = words.rolling(x, width), words.second_rolling(x, width)
        assert len(one) == len(two) == len(x) - width + 1
        for at in (0, 65_530, 65_535, 65_536, 200_000, len(x) - width):  # also across the edges of what is hashed at once
            assert one[at] == words.rolling(x[at : at + width], width)[0]
            assert two[at] == words.second_rolling(x[at : at + width], width)[0]
    assert max(len(t) for pair in words._powers.values() for t in pair) < 1 << 17
