import pytest

from fieldloom.plans import registry
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_entry_works():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "slow_call_stats" in e.queries()
