"""Every query of the engine's own operators against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from webframe.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return tuple(map(cell, x)) if isinstance(x, list) else str(x) if isinstance(x, dict) else x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(cell(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in found.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert bag(found.columns, rows) == bag(columns, want.fetchall())
