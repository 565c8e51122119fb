"""Every query against its SQL, on the smallest tables. ``ORACLE_SF`` picks larger ones."""

import os

import pytest
from oracle import compare, connect

from millrace.plans import load_all

SF_DIR = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SF_DIR, allow_empty=True) is None


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
