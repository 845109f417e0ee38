"""Queries of archive records, indexes, revisits, link conversion and file names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webframe.config import CrawlConfig
from webframe.operators import archive as A
from webframe.operators import convert as C
from webframe.operators import frontier as fr
from webframe.operators import saving
from webframe.plans.catalog import query
from webframe.plans.inputs import CANONICAL_SQL, FRONTIER_SQL, LINKS_SQL, anchor_links, frontier, pages
from webframe.functions import urls as U
from webframe.session import checkpoint_dir, cut, remove, table
from webframe.sources import cdx, warc

_BODY = "encode(coalesce(text, ''))"
_INDEX_SQL = f"""
WITH b AS (SELECT doc_id, {_BODY} AS body FROM documents),
i AS (SELECT doc_id, doc_id // 1000 AS file_no, octet_length(body) AS size, sha1(body) AS digest FROM b),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file_no ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM i)
"""


def _digests(spark, d):
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return table(spark, d, "documents").select("doc_id", F.octet_length(body).cast("long").alias("size"), F.sha1(body).alias("digest"))


def _index(spark, d):
    rows = _digests(spark, d).withColumn("file_no", F.floor(F.col("doc_id") / 1000).cast("long"))
    rows = A.offsets(rows, "file_no", "size", F.col("doc_id"))
    name = A.file_name("archive", F.col("file_no"))
    return rows.select(
        "doc_id", F.concat(F.lit("http://docs.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("20240101000000").alias("ts"), F.lit("text/plain").alias("mime"),
        F.lit(200).alias("code"), "digest", "size", "offset", name.alias("file"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"),
    )


@query(f"SELECT doc_id, CAST(octet_length({_BODY}) AS BIGINT) AS size, sha1({_BODY}) AS digest FROM documents")
def payload_digest(spark, d):
    return _digests(spark, d)


@query()
def payload_digest_b32(spark, d):
    """Base 32 is beyond SQL; tests compare it with hashlib."""
    return table(spark, d, "documents").select("doc_id", A.digest_base32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("digest"))


@query(f"WITH x AS (SELECT doc_id, sha1({_BODY}) AS digest FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS first_id, doc_id > min(doc_id) OVER (PARTITION BY digest) AS revisit FROM x")
def revisit_dedup(spark, d):
    rows = A.first_of_digest(_digests(spark, d).select("doc_id", "digest"), "digest", "doc_id")
    return rows.select("doc_id", "first_id", (F.col("doc_id") > F.col("first_id")).alias("revisit"))


@query(f"SELECT page_id, CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > least_id THEN 'w' || least_id END AS refers_to FROM (SELECT page_id, min(page_id) OVER (PARTITION BY {CANONICAL_SQL}, sha1(encode(html))) AS least_id FROM pages)")
def revisit_marks(spark, d):
    rows = pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("url"), F.sha1(F.col("html").cast("binary")).alias("payload_digest"))
    firsts = rows.groupBy("url", "payload_digest").agg(F.min("page_id").alias("p"))
    known = firsts.select("url", "payload_digest", F.concat(F.lit("w"), F.col("p").cast("string")).alias("warc_id"))
    own = F.col("refers_to") == F.concat(F.lit("w"), F.col("page_id").cast("string"))
    marked = A.mark_revisits(rows, known)
    return marked.select("page_id", F.when(own, "response").otherwise(F.col("record_type")).alias("record_type"), F.when(~own, F.col("refers_to")).alias("refers_to"))


@query(f"{_INDEX_SQL} SELECT concat_ws(' ', 'http://docs.example/' || doc_id, '20240101000000', 'text/plain', '200', digest, size, \"offset\", 'archive-' || lpad(CAST(file_no AS VARCHAR), 5, '0') || '.warc.gz', 'r' || doc_id) AS line FROM o")
def cdx_index(spark, d):
    return A.cdx_lines(_index(spark, d))


@query(f"{_INDEX_SQL} SELECT 'http://docs.example/' || doc_id AS url, 'r' || doc_id AS warc_id, digest AS payload_digest FROM o")
def cdx_roundtrip(spark, d):
    folder = f"{checkpoint_dir(spark)}/cdx_roundtrip-{uuid.uuid4().hex}"
    cdx.write_cdx(_index(spark, d), folder)
    return cdx.visits_from_cdx(cdx.read_cdx(spark, folder))


@query(f"SELECT {CANONICAL_SQL} AS url, 1704067200 + page_id AS ts, 'text/html' AS mime, CASE WHEN page_id % 3 = 0 THEN '404' ELSE '200' END AS code, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, sha1(encode(coalesce(html, ''))) AS digest, true AS same, true AS within FROM pages")
def archives_saved(spark, d):
    """Pages are written as archives that rotate and are indexed; each response of the index is read again from its place."""
    code = F.when(F.col("page_id") % 3 == 0, "404 Not Found").otherwise("200 OK")
    head = F.concat(F.lit("HTTP/1.1 "), code, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    url = U.canonical(F.col("url"))
    docs = pages(spark, d).select(url.alias("url"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("fetched_at"), F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")).alias("request_head"), head.alias("response_head"), F.col("html").alias("body"))
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    saving.save_archives(docs, CrawlConfig(warc_cdx=True, warc_max_size=1 << 20), folder)
    index = cdx.read_cdx(spark, f"{folder}/cdx").toDF("x_a", "x_b", "x_m", "x_s", "x_k", "x_size", "x_V", "x_g", "x_u")
    back = warc.fetch(index.select(F.col("x_g").alias("file"), F.col("x_V").alias("offset")), f"{folder}/archives")
    payload = F.expr("substring(block, instr(cast(block AS STRING), '\r\n\r\n') + 4)")
    rows = back.join(index, F.col("id") == F.col("x_u")).select(
        "url", F.col("x_b").cast("long").alias("ts"), F.col("x_m").alias("mime"), F.col("x_s").alias("code"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"),
        ((F.col("url") == F.col("x_a")) & (F.unix_timestamp("date", "yyyy-MM-dd'T'HH:mm:ssX") == F.col("x_b").cast("long")) & (A.digest_base32(payload) == F.col("x_k"))).alias("same"),
        (F.col("length") == F.col("x_size").cast("long")).alias("within"),
    )
    rows = cut(rows)  # the archives have been read and can go
    remove(spark, folder)
    return rows


@query()
def warc_rotation(spark, d):
    """Files rotate at 8 KiB, which writers reach at every size; the running sum starts anew in each file, so there is no SQL."""
    rows = _digests(spark, d).select("doc_id", (F.col("doc_id") % 50).alias("writer"), "size")
    return A.rotate(rows, "size", 1 << 13, "writer", F.col("doc_id"))


@query(f"WITH {LINKS_SQL}, {FRONTIER_SQL}, saved AS (SELECT DISTINCT regexp_extract(url, '^([^#]*)', 1) AS target FROM frontier WHERE status = 'done') SELECT page_id, pos, CASE WHEN target IS NULL THEN link ELSE 'f/' || sha1(encode(link)) END AS new_url FROM links LEFT JOIN saved ON link = target")
def link_convert_lookup(spark, d):
    links = anchor_links(spark, d).select("page_id", "pos", F.col("link").alias("target"))
    done = frontier(spark, d).withColumn("url", U.canonical(F.col("url"))).filter("status = 'done'").select("url", "status").distinct()
    done = done.withColumn("filename", F.concat(F.lit("f/"), F.sha1(F.col("url").cast("binary"))))
    return C.lookup(links, done).select("page_id", "pos", "new_url")


@query("SELECT page_id, CASE WHEN n = 0 THEN name ELSE name || '.' || n END AS name FROM (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS n FROM (SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS name FROM pages))")
def anti_clobber(spark, d):
    """Pages that would be saved under the names of their hosts."""
    rows = pages(spark, d).select("page_id", U.hostname(F.col("url")).alias("name"))
    return fr.anti_clobber(rows, "name", F.col("page_id"))
