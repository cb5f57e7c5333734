"""The contract of __spark_entry__."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "kind" in df.columns


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
