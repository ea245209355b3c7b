"""Every registered query against its SQL."""

import pytest
from compare import compare, duck

from fleetplan.registry.oracles import ORACLES
from fleetplan.registry.queries import QUERIES

ROWS_ONLY = {"train_forest", "evaluate_r2", "score_forest"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None
