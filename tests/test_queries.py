"""Every registered query with SQL returns the same rows as DuckDB; the others return rows."""

import pytest

import __spark_entry__ as entry
from artifactgate import catalog
from oracle import same

SF = "/root/testdata/sf0.001"
ORDER = sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", ORDER)
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, catalog.ORACLES[name], SF)
    else:
        df.count()


def test_entry(spark):
    assert set(entry.queries()) >= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
