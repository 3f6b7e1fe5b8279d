"""Every registered query against its SQL oracle; queries without one must return rows."""

import sys
import pathlib

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"t03_top_with_support", "r09_cold_start"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [dict(zip(df.columns, r)) for r in df.collect()]
    if name in ORACLES:
        assert compare(df.columns, rows, ORACLES[name], con) is None
    elif name not in MAY_BE_EMPTY:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
