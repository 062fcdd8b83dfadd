"""Every query with SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from statewright.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return f"{float(v):.8g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([columns[k] for k in order] and [tuple(plain(r[k]) for k in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
