"""Every registered query of the engine against the same in DuckDB."""

import pytest
from conftest import same_rows
from ferrule.plans import catalogue, contracts  # noqa: F401


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, data, duck):
    df = catalogue.QUERIES[name](spark, data)
    if name in catalogue.ORACLE_SQL:
        same_rows(df, duck.sql(catalogue.ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
