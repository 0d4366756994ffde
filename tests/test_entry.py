"""Driver contract: entry() and every registered key run at sf0.001 with a
schema that does not change between runs."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 150
    assert df.schema == entry.entry(spark).schema


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_keys_run(spark, key):
    a = entry.queries()[key](spark, SF)
    assert a.count() >= 0
    assert a.schema == entry.queries()[key](spark, SF).schema
