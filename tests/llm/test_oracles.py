import pytest

from fieldloom.llm import registry
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)
