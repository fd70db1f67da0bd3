import pytest

from tests.twins import compare
from tidegrid.plans import registry

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLE[name], D)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, D).count() > 0
