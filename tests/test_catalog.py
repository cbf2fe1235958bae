"""Every query of the core against its SQL."""

import os

import pytest

from veritrail.plans.catalog import QUERIES
from veritrail.plans.sql import SQL

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in os.listdir(sf):
        c.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{p}'")
    return c


def rows(names, order, values):
    at = [names.index(k) for k in order]
    return sorted((tuple(r[i] for i in at) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rel = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    assert rows(df.columns, order, [tuple(r) for r in df.collect()]) == rows(rel.columns, order, rel.fetchall())


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == {"p3_found", "p3_values"}
