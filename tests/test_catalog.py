"""Every registered query runs; those with SQL agree with it."""

import pytest
from compare import same

from quill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    if name in catalog.oracle_sql():
        same(df, sf, catalog.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
