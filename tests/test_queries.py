import pytest
from oracle import same

import __spark_entry__
from slotweave.plans import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
