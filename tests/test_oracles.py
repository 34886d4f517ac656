"""Every query with SQL gives the rows of its SQL; every other one has a test of its own."""

import pytest
from tests.conftest import assert_same

from rowsmith.plans import catalog

WITHOUT_SQL: set[str] = set()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck, data):
    df = catalog.queries()[name](spark, data)
    if name in WITHOUT_SQL:
        assert df.count() > 0
    else:
        assert_same(df, duck, catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
