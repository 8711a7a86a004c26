"""Every query with SQL against DuckDB; the others must run."""

from __future__ import annotations

import pytest

from leafmill.plans.queries import QUERIES, SQL
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    n, m, off = compare(QUERIES[name](spark, SF), SF, SQL[name])
    assert n == m and not off, off
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
