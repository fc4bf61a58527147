"""Queries against their oracle SQL on the smallest tables, and the driver contract."""

import compare
import pytest

import __spark_entry__ as entry
from orgweave.plans import catalog, general, review

ORACLE = {**catalog.oracle_sql(), **general.oracle_sql(), **review.oracle_sql()}
QUERIES = {**catalog.queries(), **general.queries(), **review.queries()}


@pytest.fixture(scope="module")
def con(tiny):
    return compare.connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, con, tiny, name):
    assert compare.differences(spark, con, QUERIES[name], ORACLE[name], tiny) == ""


def test_entry_lists_all_queries():
    q = entry.queries()
    assert set(catalog.queries()) | set(general.queries()) <= set(q)
    assert set(entry.oracle_sql()) <= set(q)
