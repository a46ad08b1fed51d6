"""Every query with a twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from skein.plans.harness import ORACLE_SQL, QUERIES
from tests.compare import differences, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
