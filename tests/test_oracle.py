"""Every registered query equals its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import compare
from compare import SMALL

from joblog import queries as registered


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SMALL)


def test_every_query_has_a_twin():
    # Queries of the optional subpackage that SQL cannot express are held against brute force in its own tests.
    assert set(registered.queries()) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_twins_have_plain_types(oracle):
    for name, sql in contract.oracle_sql().items():
        kinds = {r[0]: r[1] for r in oracle.execute(f"DESCRIBE {sql}").fetchall()}
        assert set(kinds.values()) <= set(compare.SPARK_TYPES), (name, kinds)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query(spark, oracle, name):
    assert compare.difference(spark, oracle, SMALL, name) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 100
    assert [r.urgency_score for r in rows] == sorted((r.urgency_score for r in rows), reverse=True)
