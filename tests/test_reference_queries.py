"""Every query with SQL gives the same rows in DuckDB, over the whole tables."""

import oracle
import pytest
from conftest import DATA

from braidwork.plans import core_queries, reference_queries

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.views(SF)


@pytest.mark.parametrize("name", sorted(reference_queries.ORACLES))
def test_same_as_sql(spark, con, name):
    assert oracle.differences(reference_queries.QUERIES[name](spark, SF), con, reference_queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(reference_queries.QUERIES) - set(reference_queries.ORACLES)))
def test_gives_rows(spark, name):
    assert reference_queries.QUERIES[name](spark, SF).count() > 0


def test_entry_has_all_queries(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(core_queries.QUERIES) | set(reference_queries.QUERIES) <= set(q)
    assert set(e.oracle_sql()) <= set(q)
    assert e.entry(spark).count() == 2
