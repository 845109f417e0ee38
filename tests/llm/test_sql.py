"""Queries that SQL can express, against DuckDB on the smallest tables; and the pipeline's laws."""

import os
from collections import Counter

import pytest

from webframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = QUERIES[name](spark, DATA).select(*columns).collect()
    assert Counter(map(repr, map(tuple, rows))) == Counter(map(repr, want.fetchall()))


def test_pipeline_keeps_the_columns_and_drops_only_rows(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in P.STAGES[:-1]:
        before = {r[0] for r in left.select("doc_id").collect()}
        left = stage(spark, left, DATA)
        assert left.columns == docs.columns, name
        after = [r[0] for r in left.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)), name
    assert {r["doc_id"] for r in P.run(spark, DATA).collect()} == set(after)
