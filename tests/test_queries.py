"""Every query outside of training data against its SQL, on the smallest tables."""

import pytest

from tidemark import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck, same):
    df = catalog.queries()[name](spark, sf)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
