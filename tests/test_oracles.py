"""Every registered query against independent SQL on the supplied tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = connect(FOLDER)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, con, name):
    assert difference(spark, con, name, FOLDER) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) > 0
    assert {r["verdict"] for r in rows} <= {"READY", "CONDITIONALLY_READY", "NOT_READY"}
