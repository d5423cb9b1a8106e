"""Every query against its SQL."""

import os

import pytest

from paperloom.plans.oracle import ORACLE
from paperloom.plans.queries import QUERIES

from .oracle_check import difference

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", list(ORACLE))
def test_rows(spark, name):
    mine, theirs, more, less = difference(spark, QUERIES[name], ORACLE[name], SF)
    assert (mine, more, less) == (theirs, [], [])


def test_every_query_runs_without_a_shared_name():
    assert set(ORACLE) == set(QUERIES)
