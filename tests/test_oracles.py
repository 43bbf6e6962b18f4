import pytest
from compare import differs, duck

from idledger.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    assert differs(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_sketches_are_close(spark, sf_dir):
    exact = registry.QUERIES["distinct_ids"](spark, sf_dir).first()["ids"]
    assert abs(registry.QUERIES["distinct_ids_approx"](spark, sf_dir).first()["ids"] - exact) <= 0.05 * exact
