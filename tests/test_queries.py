"""Every registered query runs over the smallest tables; those with SQL equal it there."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SMALL

FIRST = list(entry.catalog.QUERIES)


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", FIRST)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SMALL)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        rows = got.collect()  # all columns, so that nothing is pruned away
        assert rows and all(any(v is not None for v in r) for r in rows)
        return
    columns = sorted(got.columns)
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in res.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
