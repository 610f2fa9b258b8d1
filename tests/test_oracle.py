import oracle
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    f, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert f(spark, SF).count() > 0
    else:
        oracle.compare(spark, con, name, f, sql, SF)
