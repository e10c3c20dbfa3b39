"""Every query of the library runs at the smallest scale and equals its SQL."""

import pytest
from compare import duck, same

from lodestone.plans.catalog import ORACLES, QUERIES, flagship


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, db.execute(ORACLES[name]))
    else:
        assert df.count() >= 0 and df.columns


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
