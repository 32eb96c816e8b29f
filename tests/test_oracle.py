"""Every query that has SQL gives the same rows as DuckDB."""

from __future__ import annotations

import oracle
import pytest

from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, sf, con, name):
    assert oracle.differences(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLE_SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES
