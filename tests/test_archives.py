"""Archives: ranges of large files, pushed filters, damage, commits that are lost, single records, FTP conversations."""

import gzip
import io
import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.operators import archive as A
from webframe.operators import saving
from webframe.sources import cdx, warc

KINDS = "fields array<struct<name:string,value:string>>, block binary, payload_offset int"


def record(k, block, kind="resource", url=None, date="2024-01-02T03:04:05Z"):
    return warc.serialize([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Target-URI", url or f"http://h/{k:05d}"), ("WARC-Date", date)], block)


def rows(count, seed=1):
    rng = random.Random(seed)
    return [([("WARC-Type", rng.choice(["response", "request"])), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Target-URI", f"http://h/{k:05d}"), ("WARC-Date", f"2024-01-{1 + k * 28 // count:02d}T00:00:00Z")], rng.randbytes(rng.randrange(400)), None) for k in range(count)]


def pieces(data, cuts, **more):
    """What ranges find, one after another."""
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
        out += list(warc.records(io.BytesIO(data), len(data), a, b, **more))
    return out


@pytest.mark.parametrize("pack", [gzip.compress, lambda x: x])
def test_ranges_find_each_record_once(pack, monkeypatch):
    rng = random.Random(3)
    blocks = [rng.choice([b"", b"x" * rng.randrange(3000), rng.randbytes(rng.randrange(5000)), b"WARC/1.0\n\n", b"\x1f\x8b\x08" * 9]) for _ in range(60)]
    parts = [pack(record(k, b)) for k, b in enumerate(blocks)]
    data = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    for read, feed in ((1 << 20, 1 << 13), (4096, 512), (997, 101)):
        monkeypatch.setattr(warc, "_READ", read)
        monkeypatch.setattr(warc, "_FEED", feed)
        for cuts in ([], [1], [len(data) // 2], sorted(rng.sample(range(1, len(data)), 12)), starts[5:50:9]):
            found = pieces(data, cuts)
            assert [(f.offset, f.length, f.block) for f in found] == [(s, len(p), b) for s, p, b in zip(starts, parts, blocks, strict=True)]


def test_members_of_many_records_and_of_none():
    one = gzip.compress(record(1, b"a") + record(2, b"b")) + gzip.compress(b"") + gzip.compress(record(3, b"c"))
    found = list(warc.records(io.BytesIO(one), len(one)))
    assert [(f.get("WARC-Record-ID")[-2], f.block) for f in found] == [("1", b"a"), ("2", b"b"), ("3", b"c")]
    assert [f.length is None for f in found] == [True, True, False] and found[0].offset == found[1].offset == 0


def test_damage_costs_what_is_damaged_alone():
    good = [gzip.compress(record(k, bytes([65 + k]) * 50)) for k in range(5)]
    broken = [good[1][:-12], good[1][:30] + b"\xff\xff\xff" + good[1][33:], gzip.compress(b"nothing"), gzip.compress(record(1, b"x")[:-9]), gzip.compress(record(1, b"x").replace(b"Content-Length", b"Content-Lenght"))]
    for bad in broken:
        data = good[0] + bad + good[2] + good[3]
        for cuts in ([], [len(good[0]) + 3], [len(good[0]), len(good[0] + bad) + 1]):
            found = pieces(data, cuts)
            assert [f.block[:1] for f in found if f.fields is not None] == [b"A", b"C", b"D"], (bad, cuts)
            assert sum(f.fields is None for f in found) == 1
    plain = [record(k, bytes([65 + k]) * 50) for k in range(4)]
    data = plain[0] + plain[1].replace(b"Content-Length: 50", b"Content-Length: 49") + plain[2] + plain[3][:-20]
    assert [(f.fields is None, f.block[:1]) for f in pieces(data, [])] == [(False, b"A"), (True, b""), (False, b"C"), (True, b"")]


def test_time_is_linear_in_members():
    member = gzip.compress(record(1, random.Random(1).randbytes(2500)))

    def seconds(n):
        data = member * n
        begun = time.process_time()
        assert sum(1 for _ in warc.records(io.BytesIO(data), len(data))) == n
        return time.process_time() - begun

    assert seconds(8000) < 9 * max(seconds(2000), 0.05)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(8)
    blocks = [rng.randbytes(2000) for _ in range(600)]
    with open(tmp_path / "big.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(record(k, b)) for k, b in enumerate(blocks)))
    read = warc.read_warc(spark, str(tmp_path), split_bytes=100_000)
    assert read.rdd.getNumPartitions() == -(-os.path.getsize(tmp_path / "big.warc.gz") // 100_000) > 10
    assert sorted((r["id"], bytes(r["block"])) for r in read.collect()) == sorted((f"<urn:uuid:{k}>", b) for k, b in enumerate(blocks))
    assert warc.read_warc(spark, str(tmp_path), split_bytes=0).rdd.getNumPartitions() == 1


def test_filters_open_only_their_ranges(spark, tmp_path):
    folder = str(tmp_path / "a")
    made = rows(400)
    warc.write_warc(spark.createDataFrame(made, KINDS).coalesce(1).sortWithinPartitions(F.col("fields")[2]["value"]), folder, block_bytes=5_000)
    name = next(n for n in os.listdir(folder) if n.startswith("archive"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = warc.read_warc(spark, folder, split_bytes=20_000)
        whole = read.rdd.getNumPartitions()
        tests = {
            "url = 'http://h/00123'": lambda u, k, d: u == "http://h/00123", "url IN ('http://h/00001', 'http://h/00399', 'none')": lambda u, k, d: u in ("http://h/00001", "http://h/00399"),
            "date >= '2024-01-20' AND date < '2024-01-22T'": lambda u, k, d: "2024-01-20" <= d < "2024-01-22T", "type = 'request' AND url < 'http://h/00050'": lambda u, k, d: k == "request" and u < "http://h/00050",
            "type = 'response'": lambda u, k, d: k == "response", "url = 'none'": lambda u, k, d: False, "url LIKE '%7' AND length > 100": lambda u, k, d: u.endswith("7"), "url IS NULL": None,
        }
        for text, wanted in tests.items():
            found = read.filter(text)
            got = Counter((r["url"], r["type"], r["date"]) for r in found.collect())
            if wanted:
                assert got == Counter((f[2][1], f[0][1], f[3][1]) for f, *_ in made if wanted(f[2][1], f[0][1], f[3][1])), text
            else:
                assert [k for _, k, _ in got] == ["warcinfo"]
        few = warc.FilteringWarcReader({"path": folder, "split_bytes": "20000"})
        from pyspark.sql.datasource import EqualTo, IsNull

        assert [type(f) for f in few.pushFilters([EqualTo(("url",), "http://h/00123"), IsNull(("url",)), EqualTo(("offset",), 1)])] == [IsNull, EqualTo]
        ranges = few.partitions()
        assert len(ranges) == 1 and ranges[0].end - ranges[0].begin < 8_000 < os.path.getsize(f"{folder}/{name}") and whole > 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert warc.read_warc(spark, folder).filter("url = 'http://h/00123'").count() == 1  # by Spark


def test_a_lost_job_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    frame = spark.createDataFrame(rows(40), KINDS).repartition(3)
    warc.write_warc(frame, folder)
    have = lambda: Counter(r["id"] for r in warc.read_warc(spark, folder).filter("type <> 'warcinfo'").collect())
    before, names = have(), set(os.listdir(folder))
    assert sum(before.values()) == 40

    class Lost(warc.WarcSource):
        @classmethod
        def name(cls):
            return "lost-warc"

        def writer(self, schema, overwrite):
            made = warc.WarcWriter(self.options)
            made.commit = _lost
            made.abort = lambda messages: None  # the driver is gone
            return made

    def _lost(messages):
        raise RuntimeError("lost before the manifest")

    spark.dataSource.register(Lost)
    with pytest.raises(Exception, match="lost"):
        frame.write.format("lost-warc").mode("append").save(folder)
    left = set(os.listdir(folder)) - names
    assert left and have() == before
    with open(f"{folder}/foreign.warc", "wb") as f:
        f.write(record(77, b"of others"))
    assert have() == before + Counter(["<urn:uuid:77>"])
    assert set(warc.recover(folder)) == left and set(os.listdir(folder)) == names | {"foreign.warc"} and warc.recover(folder) == []
    failing = frame.withColumn("block", F.when(F.col("fields")[1]["value"] == "<urn:uuid:7>", F.raise_error(F.lit("a task fails")).cast("binary")).otherwise(F.col("block")))
    with pytest.raises(Exception, match="a task fails"):
        warc.write_warc(failing, folder)
    assert have() == before + Counter(["<urn:uuid:77>"])
    warc.recover(folder)
    warc.write_warc(frame, folder)
    assert have() == before + before + Counter(["<urn:uuid:77>"])


DOCS = "url string, status_code int, content_type string, disposition string, last_modified string, fetched_at string, request_head string, response_head string, body binary"


def test_records_are_valid_and_indexed(spark, tmp_path):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    times = ["2024-02-03 04:05:06", "2024-02-03 04:05:06", "2024-02-04 00:00:00", None]
    docs = spark.createDataFrame([("http://e.com/a", 200, "text/html", None, None, t, "GET /a HTTP/1.1\r\n\r\n", head, f"<p>{k}".encode()) for k, t in enumerate(times)], DOCS)
    docs = docs.withColumn("fetched_at", F.to_timestamp("fetched_at"))
    lines = [("f", 0, "note", "Opening control connection to 1.2.3.4:21"), ("f", 1, "command", "USER anonymous\r\n"), ("f", 2, "reply", "331-One\r\n331 Two\r\n"), ("f", 3, "note", "Closed control connection to 1.2.3.4:21")]
    said = A.control_conversation(spark.createDataFrame(lines, "key string, n int, kind string, text string"), "key", F.col("n"))
    transfers = said.select(F.lit("ftp://e.com/f").alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"), F.col("block").alias("conversation"), F.lit(b"file").alias("body"))
    folder = str(tmp_path / "a")
    saving.save_archives(docs, CrawlConfig(warc_cdx=True, warc_max_size=800), folder, transfers=transfers)
    read = warc.read_warc(spark, f"{folder}/archives").collect()
    assert len({r["id"] for r in read}) == len(read)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["date"]) and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", r["id"]) for r in read)
    assert Counter(r["type"] for r in read if r["type"] != "warcinfo") == {"request": 4, "response": 4, "metadata": 1, "resource": 1}
    of = lambda r, name: next((f["value"] for f in r["fields"] if f["name"] == name), None)
    info = {r["file"]: r["id"] for r in read if r["type"] == "warcinfo"}
    assert len(info) > 1 and all(of(r, "WARC-Warcinfo-ID") == info[r["file"]] for r in read if r["type"] != "warcinfo")
    assert Counter(r["date"] for r in read if r["type"] == "response")["2024-02-03T04:05:06Z"] == 2
    by = {r["type"]: r for r in read}
    assert bytes(by["metadata"]["block"]) == b"* Opening control connection to 1.2.3.4:21\r\n> USER anonymous\r\n< 331-One\r\n< 331 Two\r\n* Closed control connection to 1.2.3.4:21"
    assert of(by["metadata"], "Content-Type") == "text/x-ftp-control-conversation" and of(by["resource"], "WARC-Concurrent-To") == by["metadata"]["id"] and bytes(by["resource"]["block"]) == b"file"
    index = cdx.read_cdx(spark, f"{folder}/cdx")
    assert sorted(r["b"] for r in index.collect())[:3] == ["1706933106", "1706933106", "1707004800"]
    got = warc.fetch(index.select(F.col("g").alias("file"), F.col("V").alias("offset")), f"{folder}/archives").collect()
    assert sorted((r["id"], r["offset"], r["length"]) for r in got) == sorted((r["u"], int(r["V"]), int(r["S"])) for r in index.collect())
    assert all(r["type"] == "response" for r in got)
