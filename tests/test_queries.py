"""Each query with SQL against DuckDB on the same tables; the others give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from lexmill.plans import ORACLE_SQL, QUERIES


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, (tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)
