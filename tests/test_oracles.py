"""Every registered query against its DuckDB SQL, at the smallest scale."""

import os

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from oracle.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, connection, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert differences(frame, connection, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 15
