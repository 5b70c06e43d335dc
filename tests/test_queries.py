"""Every registered query of the core against its SQL, at the smallest scale."""

import pandas as pd
import pytest

from loomgraph import catalog


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    left, right = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(left, right, check_dtype=False, check_exact=True)


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
