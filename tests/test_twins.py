"""Every registered query that has a SQL twin gives the twin's rows."""

from __future__ import annotations

import decimal

import duckdb
import pytest

import tideframe.queries  # noqa: F401
from tideframe import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return db


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    twin = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    assert mine == twin
