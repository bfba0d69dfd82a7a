"""The registered tape queries, each against its SQL, in one session."""

import pytest

from levelscope.plans import level_oracles, level_queries, more_queries, report_queries
from levelscope.plans import oracles as tape_oracles
from levelscope.plans import queries as tape_queries

from .registered import check, duck

QUERIES = tape_queries.QUERIES | level_queries.QUERIES | more_queries.QUERIES | report_queries.QUERIES
ORACLES = tape_oracles.ORACLES | level_oracles.ORACLES | more_queries.ORACLES | report_queries.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert name in ORACLES
    check(spark, con, QUERIES[name], ORACLES[name])
