import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the benchmark tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name)) is None


def test_entry_is_the_narrative_query(spark):
    assert entry(spark).columns[:3] == ["subject_id", "prediction_time", "text"]
