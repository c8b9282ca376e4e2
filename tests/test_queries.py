"""Every registered query against its SQL twin on the smallest scale, and its plan."""

import re

import pytest
from compare import duck, mismatch
from conftest import SF

from flowtables.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|CartesianProduct", plan)
    assert mismatch(df.toPandas(), con.execute(ORACLES[name]).df()) is None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
