"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df, columns):
    text = df[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).map(lambda v: v[:-2] if v.endswith(".0") else v)
    return sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert set(columns) <= set(got.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
