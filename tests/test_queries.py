"""Every registered query of the library's own operators against its SQL."""

import pytest

from compare import duck_rows, spark_rows
from telar import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        want = duck_rows(ORACLES[name], sf_dir)
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
