"""Every query of the catalog against its SQL, over the smallest tables."""

import pytest

from trawl import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(range(len(columns)), key=columns.__getitem__)
        assert got == sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())
    else:
        assert got


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
