"""Every query against independent SQL on the same tables."""

import pytest

from tickersieve.checks.compare import connect, differences
from tickersieve.checks.oracle import ORACLE
from tickersieve.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE[name], con) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"sector", "label", "n", "score", "overvalued_share"}
