"""Every query of the library agrees with its SQL."""

import pytest

from measureaudit import catalog

from .compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    got = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    assert got == sql_rows(catalog.ORACLES[name], sf_dir)
    assert got[1], "a query that finds nothing shows nothing"


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    made = entry.queries()
    assert set(catalog.QUERIES) <= set(made)
    assert set(entry.oracle_sql()) <= set(made)
    assert entry.entry(spark).columns[:4] == ["metric", "mat", "act", "sub"]
