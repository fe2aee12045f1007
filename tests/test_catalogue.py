"""Every query of the library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lahja import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert found == rows(names, want.fetchall())


def test_flagship(spark):
    assert catalogue.FLAGSHIP in catalogue.queries()
