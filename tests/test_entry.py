"""Every query equals its SQL at the smallest scale."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import pytest

from ledgerlens.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    if isinstance(value, datetime | date):
        return str(value)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLES:  # the operators' own tests hold these against brute force: here they only run
        found.write.format("noop").mode("overwrite").save()
        return
    want = db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in found.select(*[f"`{c}`" for c in want.columns]).collect()]
    assert sorted(rows, key=str) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_entry_works_without_the_training_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
