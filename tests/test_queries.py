"""Every registered query of the library against its oracle, or, where it has none, against its invariants."""

import pytest

from evidentia.queries import QUERIES, SQL

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    compare(spark, name, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0
    first = sorted(map(str, rows.collect()))
    assert first == sorted(map(str, QUERIES[name](spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
