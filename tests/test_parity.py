"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from parity import compare, connect
from patchloom.plans import registry

SF = "/root/testdata/sf0.001"
# queries of the training-data subpackage have tests of their own
QUERIES = {n: f for n, f in queries().items() if n in registry.QUERIES}
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name)) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and any(r["model"] == "ALL" for r in rows)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {
        "parse_karma", "parse_calypso", "parse_p5js", "parse_doctest", "import_edges", "docs_docstrings", "docs_signatures",
    }
