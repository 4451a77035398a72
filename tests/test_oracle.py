"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from wardlight.plans.catalog import PLANS

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_equals_sql(spark, con, name):
    frame = entry_points.queries()[name](spark, SF_DIR).toPandas()
    assert differences(frame, con.execute(ORACLE[name]).df()) == []


def test_every_query_has_sql():
    assert set(PLANS) <= set(ORACLE) and set(ORACLE) <= set(entry_points.queries())


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["prompt_version", "total_incidents", "matched_count", "accuracy_percentage"]
    assert [r["prompt_version"] for r in frame.collect()] == ["v1.2.0", "v1.1.0", "v1.0.0"]
