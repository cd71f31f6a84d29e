"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from lodestar import catalog
from lodestar.queries.base import CASES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    cases, fn, given = CASES[name]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], f"n int, given {given}")
    got = {r.n: r.result for r in df.select("n", fn(df["given"]).alias("result")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
