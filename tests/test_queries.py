"""Every query against its SQL over the given tables."""

import os

import pytest

import __spark_entry__ as entry_points
import check
from lapline.plans import oracles, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    result = check.compare(spark, FOLDER, [name])[name]
    assert result.startswith("ok"), result


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)
    assert set(queries.QUERIES) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 75
