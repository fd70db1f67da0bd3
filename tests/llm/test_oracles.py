import pytest

from tests.twins import compare
from tidegrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.01")
