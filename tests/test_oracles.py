"""Every query of the store against its oracle."""

import pytest

from cairnlake import plans

plans.load()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_oracle(name, agree):
    agree(plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(name, spark):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
