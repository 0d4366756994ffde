"""Every key with an oracle: Spark result == DuckDB result (row count,
column names, order-insensitive value hash), at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from botsift.sources.fixtures import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_key_is_registered():
    assert set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
