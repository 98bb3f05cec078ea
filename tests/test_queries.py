"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare

FOLDER = os.environ.get("SPARKWAVE_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = dict(entry.registry.QUERIES), dict(entry.registry.SQL)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, FOLDER, name, QUERIES[name], SQL.get(name)) == ""
