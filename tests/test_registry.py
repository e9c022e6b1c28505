"""Every registered query against its SQL on the generated tables."""

import os

import pytest
from compare import compare, connect

from loanframe.checks import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"rate_model", "scored_applications"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, connection, name):
    outcome = compare(spark, connection, SF, name, registry.QUERIES[name], registry.ORACLE[name])
    assert outcome is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - SLOW))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
