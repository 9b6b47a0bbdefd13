"""Every query against its SQL on the smallest tables, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from scryline import registry
from tests.conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, spark, duck):
    same(registry.QUERIES[name](spark, SMALL), duck, registry.SQL[name])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc", "rank", "vector_score", "bm25_score", "score"]
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_others_give_rows(name, spark):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
