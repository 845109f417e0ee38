"""Queries without SQL, or whose SQL once read a part, over whole texts."""

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_queries_read_whole_texts(spark, tmp_path):
    from urllib.parse import quote

    from webframe.plans import catalog

    rows = [(k, "\n ".join(f"wörd {k}, x{i}\t" for i in range(200))) for k in range(5)] + [(9, "short"), (10, "")]
    spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    encoded = {r["doc_id"]: r["encoded"] for r in catalog.QUERIES["url_percent_encode"](spark, str(tmp_path)).collect()}
    assert encoded == {i: quote(re.sub("[^a-zA-Zà-ÿ ]", "", t)) for i, t in rows}
    soup = {r["doc_id"]: r["soup"] for r in catalog.QUERIES["link_soup_clean"](spark, str(tmp_path)).collect()}
    assert soup == {i: "".join(x.strip() for x in t.split("\n")) for i, t in rows}


def test_writers_rotate_and_script_links_are_whole(spark, tmp_path):
    from webframe.plans import catalog

    rng = random.Random(6)
    rows = [(k, "x" * rng.randrange(6000)) for k in range(400)]
    spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want, held, seq = {}, Counter(), Counter()
    for i, t in rows:
        if held[i % 50] > 8192:
            seq[i % 50] += 1
            held[i % 50] = 0
        want[i] = seq[i % 50]
        held[i % 50] += len(t)
    assert {r["doc_id"]: r["file_seq"] for r in catalog.QUERIES["warc_rotation"](spark, str(tmp_path)).collect()} == want and max(want.values()) > 0
    pages = [(1, "http://h.example/", '<script>var u = "http://b.example/own.html";</script>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["link"] for r in catalog.QUERIES["links_js"](spark, str(tmp_path)).collect()} == {"http://a.example/1/x.html", "http://b.example/own.html"}
