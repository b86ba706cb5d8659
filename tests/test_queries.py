"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from parity import bag, views  # noqa: E402

from gridloom.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    res = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(res.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
