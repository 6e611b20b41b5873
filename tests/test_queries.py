"""Every registered query has the columns and rows its oracle gives, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in ORACLES))
def test_query_matches_its_oracle(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    want = sorted((tuple(map(repr, (dict(zip(columns, r))[c] for c in df.columns))) for r in rel.fetchall()))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(repr, r)) for r in df.collect()) == want


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
