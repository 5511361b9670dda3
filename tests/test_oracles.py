"""Every registered query against its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import canonical


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    got = canonical(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == canonical(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["splits", "n_groups", "n_files", "consistent", "conflicting"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
