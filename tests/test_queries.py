"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

import compare
from vicinity.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        out = compare.connect(SMALL).execute(registry.ORACLES[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        assert compare.canonical(rows, df.columns) == compare.canonical(out.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    # ten neighbours of every row whose id is divisible by 20, of 500
    assert __spark_entry__.entry(spark).count() == 250
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
