"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from medialog.registry import REGISTRY

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) == []


def test_entry_has_a_row_per_show(spark):
    assert entry.entry(spark).count() == 10


def test_entry_lists_every_registered_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
