import pytest

from skein.queries import ORACLES, QUERIES

from . import oracle


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name], sf_dir)


def test_catalogue_has_each_type_once(spark, sf_dir):
    types = [r.type for r in QUERIES["node_type_catalogue"](spark, sf_dir).collect()]
    assert len(types) == len(set(types)) == 157
    assert "static get" in types and "static" in types and "static_get" not in types


def test_entry(spark):
    import __spark_entry__ as registry

    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
