import pytest

from quillspark.plans import all_oracles, all_queries
from tests.conftest import SF
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_sql(spark, con, name):
    same(spark, con, SF, all_queries()[name], all_oracles()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_rows(spark, name):
    df = all_queries()[name](spark, SF)
    assert df.columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
