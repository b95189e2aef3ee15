"""Every registered query next to its SQL counterpart, on the smallest tables."""

import os

import duckdb
import pytest

from check import rows_of
from spanloom.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())
    assert got, "a query over whole tables returns rows"


def test_names():
    assert not any("pipeline" in n or n.startswith("op") for n in QUERIES)
    assert set(ORACLE) <= set(QUERIES)
