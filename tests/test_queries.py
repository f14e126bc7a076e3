"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import DATA, difference

from quillon.plans import registry

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLE:
        assert difference(df, registry.ORACLE[name], SMALL) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
