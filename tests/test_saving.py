"""The series of steps after a crawl, by configuration."""

import gzip
import os

from webframe.config import CrawlConfig
from webframe.operators import saving
from webframe.sources import cdx, warc

COLS = "url string, status_code int, content_type string, disposition string, last_modified string, fetched_at timestamp, request_head string, response_head string, body binary"


def documents(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\n\r\n"
    rows = [
        ("http://e.com/d/i", "text/html", None, '<html><a href="/x.css">x</a><a href="?q=1">y</a>'),
        ("http://e.com/d/i?q=1", "text/html", 'attachment; filename="ü:1.html"', "<html>two"),
        ("http://e.com/x.css", "text/css", None, "a{background:url(p.png)}"),
        ("http://e.com/x.css?again", "text/css", None, "a{background:url(p.png)}"),
    ]
    return spark.createDataFrame([(u, 200, k, d, None, None, f"GET {u} HTTP/1.1\r\n\r\n", head.format(k), b.encode()) for u, k, d, b in rows], COLS)


def test_names_follow_the_options(spark):
    docs = documents(spark)
    plain = {r["url"]: r["path"] for r in saving.named(docs, CrawlConfig()).collect()}
    assert plain["http://e.com/d/i"] == "./e.com/d/i" and plain["http://e.com/x.css?again"].endswith("x.css?again")
    config = CrawlConfig(adjust_extension=True, content_disposition=True, restrict_file_names=("windows", "ascii", "lower"), max_filename_length=20)
    found = {r["url"]: r["path"] for r in saving.named(docs, config).collect()}
    assert found["http://e.com/d/i"] == "./e.com/d/i.html"
    assert found["http://e.com/d/i?q=1"].rsplit("/", 1)[1] == "%c3%bc%3a1.html"
    assert found["http://e.com/x.css?again"].rsplit("/", 1)[1] == "x.css%3fagain.css"


def test_series_of_steps(spark, tmp_path):
    docs, folder = documents(spark), str(tmp_path / "a")
    config = CrawlConfig(convert_links=True, backup_converted=True, warc_cdx=True, warc_dedup=True, warc_max_size=700)
    visits = spark.createDataFrame([("http://e.com/x.css", "<urn:uuid:old>", warc.sha1_base32(b"a{background:url(p.png)}").removeprefix("sha1:"))], "url string, warc_id string, payload_digest string")
    assert saving.finish(docs.coalesce(1), config, folder, visits) == ["archives", "files", "conversion"]
    assert spark.read.parquet(f"{folder}/files").count() == 4
    kept = {r["path"]: bytes(r["body"]).decode() for r in spark.read.parquet(f"{folder}/converted").collect()}
    assert kept["./e.com/d/i"] == '<html><a href="../x.css">x</a><a href="i?q=1">y</a>' and '"/x.css"' in kept["./e.com/d/i.orig"]
    names = [n for n in os.listdir(f"{folder}/archives") if n.endswith(".gz")]
    assert len(names) > 1
    kinds = {}
    for r in warc.read_warc(spark, f"{folder}/archives").collect():
        f = {x["name"]: x["value"] for x in r["fields"]}
        kinds.setdefault(f["WARC-Type"], []).append(f)
    assert {k: len(v) for k, v in kinds.items()} == {"warcinfo": len(names), "request": 4, "response": 3, "revisit": 1}
    assert kinds["revisit"][0]["WARC-Refers-To"] == "<urn:uuid:old>" and {f["WARC-Concurrent-To"] for k in ("response", "revisit") for f in kinds[k]} == {f["WARC-Record-ID"] for f in kinds["request"]}
    lines = cdx.read_cdx(spark, f"{folder}/cdx").collect()
    assert len(lines) == 3
    for r in lines:  # each record can be inflated from its offset
        with open(f"{folder}/archives/{r['g']}", "rb") as f:
            f.seek(int(r["V"]))
            assert r["u"].encode() in gzip.decompress(f.read())[:400]
    assert saving.finish(docs, CrawlConfig(delete_after=True, convert_links=True), str(tmp_path / "b")) == ["archives", "files"]
    assert not os.path.exists(tmp_path / "b" / "files")
    assert saving.finish(docs, config, str(tmp_path / "c"), stop_before="files") == ["archives"]


def test_one_document_of_all_bodies_with_heads(spark, tmp_path):
    docs = documents(spark).repartition(3)
    rows = [(r["url"], bytes(r["body"]), r["response_head"]) for r in docs.collect()]
    config = CrawlConfig(output_document=True, save_headers=True, convert_links=True)
    assert saving.finish(docs, config, str(tmp_path)) == ["archives", "files"]
    names = sorted(n for n in os.listdir(tmp_path / "document"))
    assert all(n.startswith("part-") for n in names)
    whole = b"".join((tmp_path / "document" / n).read_bytes() for n in names)
    assert whole == b"".join(head.encode() + body for _, body, head in sorted(rows))
    saving.finish(docs, CrawlConfig(save_headers=True), str(tmp_path / "b"))
    kept = {bytes(r["body"]) for r in spark.read.parquet(str(tmp_path / "b" / "files")).collect()}
    assert kept == {head.encode() + body for _, body, head in rows}
