"""Every query that SQL can express gives the rows that DuckDB gives over the same files."""

from __future__ import annotations

import math
import os
from datetime import datetime

import duckdb
import pytest

from routelens.adapters import TABLES
from routelens.plans import catalogue

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return None if math.isnan(float(x)) else float(x) + 0.0
    return x.replace(tzinfo=None) if isinstance(x, datetime) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda x: str(tuple(round(y, 4) + 0.0 if isinstance(y, float) else y for y in x)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = duck.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    want, have = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(have)
    # results are rounded to six places: their last one may differ by the order of sums, nothing more
    close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1.01e-6 * max(1, abs(a) / 1e6)
    assert all(close(a, b) for x, y in zip(want, have, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLE)))
def test_other_queries_run_and_repeat(spark, name):
    first, again = (catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect() for _ in range(2))
    assert first and sorted(first, key=str) == sorted(again, key=str)
