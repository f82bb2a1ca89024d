"""Every query with an oracle gives the oracle's rows at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_library_query_has_an_oracle():
    from suite import load

    assert set(load().QUERIES) == set(load().ORACLES)


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op") and n != "pipeline"])
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
