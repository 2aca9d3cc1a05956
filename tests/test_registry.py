"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry
from locusframe.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def shown(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame):
    return sorted("|".join(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, tables):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        want = tables.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0  # compared with plain versions in the other tests


def test_entry_has_rows(spark):
    assert 0 < registry.entry(spark).count() <= 20


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
