"""Every registered query of the main library against its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import numpy as np
import pytest

from sparkloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.8g}")
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(found, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    told = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(got.columns)
    want = rows(told.fetchall(), [names.index(c) for c in sorted(names)])
    assert rows(got.select(*sorted(names)).collect(), range(len(names))) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
