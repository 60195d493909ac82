"""Registered queries run, and equal their SQL where they have one."""

from __future__ import annotations

import duckdb
import pytest

from folioloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cells(rows, columns):
    return sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, DIR)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(map(tuple, got.collect()), got.columns) == cells(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
