"""Registered queries against their SQL on the driver's small tables."""

import math

import pytest

from quarrylens.plans import registry


def rows(df):
    cols = sorted(df.columns)
    cell = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.6f}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_small, duck, name):
    got = registry.queries()[name](spark, sf_small)
    want = duck(registry.oracle_sql()[name], sf_small)
    assert rows(got.toPandas().astype(object).where(lambda x: x.notna(), None)) == rows(want.astype(object).where(lambda x: x.notna(), None))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
