"""Operators beyond SQL against plain loops."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from webframe.operators import archive as A
from webframe.operators import frontier as fr
from webframe.operators import stats as S
from webframe.plans import catalog
from webframe.sources import cdx
from webframe.sources import warc as W


def test_digest_base32(spark):
    rows = spark.createDataFrame([(b"a",), (b"",), (None,)], "b binary").select("b", A.digest_base32(F.col("b")).alias("d")).collect()
    for r in rows:
        assert r["d"] == (None if r["b"] is None else base64.b32encode(hashlib.sha1(bytes(r["b"])).digest()).decode())


def test_rotation_starts_a_file_once_the_last_is_over_its_size(spark):
    rows = spark.createDataFrame([("w", i, 40) for i in range(10)], "w string, i int, size long")
    found = {r["i"]: r["file_seq"] for r in A.rotate(rows, "size", 100, "w", F.col("i")).collect()}
    assert [found[i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_merged_samples(spark):
    times = [(0.0, 10), (0.1, 10), (0.2, 10), (0.3, 10), (0.9, 10), (7.0, 0), (7.1, 5), (7.2, 1)]
    feeds = spark.createDataFrame([("a", t, n) for t, n in times], "k string, t double, n long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    found = sorted((round(r["seconds"], 6), r["n"], r["stalled"]) for r in S.merge_samples(feeds, "k", "ts", "n").collect())
    # a sample begins where the last one ended; nothing for six seconds is a stall and no sample
    assert found == [(0.2, 6, True), (0.2, 30, False), (0.7, 20, False)]


def test_insert_ignores_known_and_repeated_urls(spark):
    seeds = spark.createDataFrame([(1, "http://a/"), (2, "http://b/"), (3, "http://a/")], "seq long, url string")
    frontier = fr.insert(fr.empty(spark), seeds)
    assert sorted((r["seq"], r["url"]) for r in frontier.collect()) == [(1, "http://a/"), (2, "http://b/")]
    again = fr.insert_new(frontier, spark.createDataFrame([(9, "http://b/"), (10, "http://c/")], "seq long, url string"))
    assert [r["url"] for r in again.collect()] == ["http://c/"]


def test_warc_round_trip(spark, tmp_path):
    folder = str(tmp_path / "w")
    fields = [("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:1>")]
    blob = W.serialize(fields, b"block\r\n\r\nbytes")
    import io
    import os

    (found,) = W.records(io.BytesIO(blob), len(blob))
    assert (found.offset, found.length, found.block, found.get("warc-type")) == (0, len(blob), b"block\r\n\r\nbytes", "resource")

    os.makedirs(folder)
    with open(folder + "/a.warc", "wb") as f:
        f.write(blob + blob)
    rows = W.read_warc(spark, folder).orderBy("offset").collect()
    assert [r["offset"] for r in rows] == [0, len(blob)] and all(bytes(r["block"]) == b"block\r\n\r\nbytes" for r in rows)


def test_cdx_without_its_header_is_an_error(spark, tmp_path):
    path = tmp_path / "x.cdx"
    path.write_text("no header\n")
    with pytest.raises(ValueError):
        cdx.read_cdx(spark, str(path))


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_warc_files_rotate_and_appear_by_commit_alone(spark, tmp_path):
    import gzip
    import os

    folder = str(tmp_path / "out")
    rows = [([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{i}>")], bytes(f"head {i}\r\n\r\nbody", "ascii"), 10) for i in range(40)]
    df = spark.createDataFrame(rows, "fields array<struct<name:string,value:string>>, block binary, payload_offset int").repartition(2)
    W.write_warc(df, folder, max_size=600)
    names = sorted(n for n in os.listdir(folder) if n != W.MANIFESTS)
    assert len(names) > 4 and all(n.startswith("archive-") and n.endswith(".warc.gz") for n in names)
    read = W.read_warc(spark, folder).collect()
    ids = [next(f["value"] for f in r["fields"] if f["name"] == "WARC-Record-ID") for r in read]
    assert sorted(x for x in ids if len(x) < 14) == sorted(f"<urn:uuid:{i}>" for i in range(40)) and len(read) == 40 + len(names)
    with open(f"{folder}/{names[0]}", "rb") as f:
        data = f.read()
    members = data.count(b"\x1f\x8b\x08")
    assert members >= 2 and gzip.decompress(data).count(b"WARC/1.0") == members


def test_redirects_beyond_the_most_and_cycles(spark):
    from webframe.operators import crawl as C

    hops = [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("s", "s")]
    starts = spark.createDataFrame([(u,) for u in ("c0", "c9", "c10", "c29", "c30", "x", "s", "free")], "url string")
    for most in (20, 3, 1):
        found = {r["url"]: (r["final_url"], r["n_hops"], r["ended"]) for r in C.redirect_chains(starts, spark.createDataFrame(hops, "url string, location string"), most).collect()}
        want = {f"c{i}": ("c30", 30 - i, True) if 30 - i <= most else (None, most + 1, False) for i in (0, 9, 10, 29, 30)}
        assert found == want | {"free": ("free", 0, True), "x": (None, most + 1, False), "s": (None, most + 1, False)}


def test_documents_and_files(spark, tmp_path):
    from webframe.operators import writers

    docs = spark.createDataFrame([("a/b", b"x"), ("c", b"y")], "path string, body binary")
    writers.discard(docs)
    writers.write_documents(docs, str(tmp_path / "docs"))
    assert [bytes(r["body"]) for r in writers.read_document(spark, str(tmp_path / "docs"), "c").collect()] == [b"y"]
    parts = spark.createDataFrame([("c", 206, b"z"), ("a/b", 200, b"w"), ("none", 206, b"v")], "path string, code int, body binary")
    assert {r["path"]: bytes(r["body"]) for r in writers.appended(docs, parts).collect()} == {"a/b": b"x", "c": b"yz"}
    paths = spark.createDataFrame([("a/b/c",), ("d/e",), ("c/x",)], "dir_path string")
    assert {r["dir_path"]: r["safe_dir"] for r in writers.anti_clobber_dirs(paths, docs).collect()} == {"a/b/c": "a/b.d/c", "d/e": "d/e", "c/x": "c.d/x"}
    old = spark.createDataFrame([("c", 5)], "path string, last_modified int")
    new = spark.createDataFrame([("c", 5), ("c", 6), ("q", 1)], "path string, last_modified int")
    assert sorted(map(tuple, writers.newer_only(new, old).collect())) == [("c", 6), ("q", 1)]
    assert [r["path"] for r in writers.ignore_existing(new, old).collect()] == ["q"]


def test_robots_rules_in_bytes(spark):
    from webframe.operators import robots

    body = "User-agent: *\nDisallow: /é" + "é" * 2100 + "\nDisallow: /late\n"
    files = spark.createDataFrame([("http://h.example", body)], "origin string, body string")
    assert robots.rules(files).count() == 1 and robots.rules(files, max_bytes=None).count() == 2


def test_converted_documents(spark):
    from webframe.operators import convert

    docs = [("http://e.com/d/i.html", "html", "e.com/d/i.html", '<a href="../x.html">x</a><img src=\'/p.png\'><a href="#f">f</a><p title="href=x">'), ("http://e.com/s.css", "css", "e.com/s.css", "a{background:url(p.png)} @import 'q.css';")]
    frame = spark.createDataFrame(docs, "url string, kind string, filename string, body string")
    saved = spark.createDataFrame([("http://e.com/x.html", "done", "e.com/x.html"), ("http://e.com/p.png", "done", "e.com/p.png"), ("http://e.com/q.css", "error", None)], "url string, status string, filename string")
    found = {r["url"]: r["converted"] for r in convert.convert_documents(frame, saved).collect()}
    assert found == {
        "http://e.com/d/i.html": '<a href="../../e.com/x.html">x</a><img src=\'../p.png\'><a href="#f">f</a><p title="href=x">'.replace("../../e.com/", "../"),
        "http://e.com/s.css": "a{background:url(p.png)} @import 'http://e.com/q.css';",
    }


def test_scans_in_chunks_equal_whole_scans(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from webframe.operators import scrapers as S

    rng = random.Random(7)
    texts = ["", None, "abcdefgh ijk", "a" * 40, " ", "ab " * 30, "x" * 7 + " " + "y" * 8 + " z", "éé漢漢 ab" * 5] + ["".join(rng.choice("ab -é") for _ in range(rng.randrange(80))) for _ in range(60)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for pattern in ("[a-z]+", "[a-z]+ ?[a-z]?", "a-?b|b a", "[^ ]+"):
        for chunk in (1, 3, 4, 7, 100):
            found = {r["k"]: r["m"] for r in frame.select("k", S.scanned(F.col("t"), pattern, chunk, 90).alias("m")).collect()}
            assert found == {k: re.findall(pattern, t or "") for k, t in enumerate(texts)}, (pattern, chunk)
    assert frame.select(S.scanned(F.col("t"), "[a-z]+", 4, 8)).collect()[2][0] == ["abcdefgh", "ijk"]


def test_partial_responses_are_all_appended_in_order(spark):
    held = spark.createDataFrame([("a", b"0-"), ("b", None), ("c", b"c")], "path string, body binary")
    parts = spark.createDataFrame([("a", 206, 2, b"bb"), ("a", 206, 1, b"aa"), ("a", 206, 10, b"cc"), ("a", 500, 0, b"no"), ("b", 206, 1, b"x"), ("b", 206, 2, None), ("d", 206, 1, b"lost")], "path string, code int, seq int, body binary")
    from pyspark.sql import functions as F

    from webframe.operators import writers

    found = {r["path"]: bytes(r["body"]) for r in writers.appended(held, parts, F.col("seq")).collect()}
    assert found == {"a": b"0-aabbcc", "b": b"x", "c": b"c"}


def test_scans_of_long_texts_take_time_by_their_length(spark):
    """Patterns once went over the whole text again for each of its parts: minutes for texts of this length."""
    import re
    import time

    from pyspark.sql import functions as F

    from webframe.operators import scrapers as S

    text = "Ab cd " * 40_000
    frame = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    parts = frame.select(S.segments(F.col("t"), "[A-Z][a-z]+").alias("m")).first()["m"]
    assert "".join(p["text"] for p in parts) == text and [p["text"] for p in parts if p["is_link"]] == ["Ab"] * 40_000
    for pattern, chunk in (("[A-Z][a-z]+", 1_000), ("[a-zA-Z]+(?: [a-z]+)?", 300)):
        assert frame.select(S.scanned(F.col("t"), pattern, chunk, 200).alias("m")).first()["m"] == re.findall(pattern, text)
    assert time.time() - began < 60


def test_scans_pass_chunks_that_a_match_covers(spark):
    from pyspark.sql import functions as F

    from webframe.operators import scrapers as S

    frame = spark.createDataFrame([("a" * 11 + " b" + "😀" * 3 + "cc",)], "t string")
    assert frame.select(S.scanned(F.col("t"), "[a-z]+|x*", 2, 20).alias("m")).first()["m"] == ["a" * 11, "b", "cc"]
