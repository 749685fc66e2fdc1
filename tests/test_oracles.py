"""Every registered query of the core against its SQL."""

import pytest

from compare import oracle_rows, rows_of
from loomwright import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
FIXTURES = registry.fixtures()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    names, expected = oracle_rows(ORACLES[name], sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixture(spark, sf_dir, name):
    """Fixed rows against typed-in results."""
    run, sql = FIXTURES[name]
    df = run(spark, sf_dir)
    if sql is None:
        assert df.count() > 0
        return
    names, expected = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
