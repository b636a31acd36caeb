"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite import all_queries
from tests.conftest import TESTDATA
from tests.test_plans import check_rules
from tools.check_queries import compare, connect

QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, folder, duck):
    df = QUERIES[key](spark, folder)
    if key in ORACLES:
        assert compare(df, duck, ORACLES[key]) is None
    else:
        assert df.count() > 0
    check_rules(key, df)


def test_entry_is_not_empty(spark):
    assert entry.entry(spark).count() > 0


def test_only_the_approximate_search_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"vector_ann"}
