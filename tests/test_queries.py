"""Every query with SQL equals it on the smallest tables."""

import os
import re

import pytest
from compare import compare, duck

from tidemark.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert not any(re.match(r"op\d", n) or "pipeline" in n for n in QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ok, text, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, text
