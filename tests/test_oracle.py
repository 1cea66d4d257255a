"""Every registered query outside the text subpackage against its SQL, or at least run."""

from __future__ import annotations

import pytest

from quadrille.plans.registry import ORACLE_SQL, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    oracle.same(spark, name, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, oracle.SF_DIR)
    assert found.columns and found.count() > 0
