import pytest

from metaspan.llm import queries

from ..oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]())
