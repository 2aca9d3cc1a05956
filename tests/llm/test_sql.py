"""The queries that have SQL against it, all columns, on the smaller tables and on edge cases."""

import os

import duckdb
import pytest

from locusframe.llm.queries import ORACLE_SQL, QUERIES


def tables(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    return con


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, sf, spark):
    folder = f"/root/testdata/sf{sf}"
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = tables(folder).execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key)
