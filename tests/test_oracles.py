"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lidarlake.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
