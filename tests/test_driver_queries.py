"""Registered queries against their SQL, and the shape of their plans."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from contagrid.plans.driver_queries import QUERIES
from helpers import plan
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 1


@pytest.mark.parametrize("name", ["case_contact_indicators", "resolve_territory", "school_split", "followup_counts", "outcome_breakdown_blocks"])
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_scans_read_only_used_columns(spark):
    text = plan(queries()["outcome_by_territory"](spark, SF_DIR))
    assert "o_totalprice" not in text and "c_name" not in text


def test_status_filter_reaches_the_scan(spark):
    from contagrid.operators.followup import followup_cube
    from contagrid.plans.roles import AS_OF_EVENTS
    from helpers import SLOTS

    path = f"{spark.conf.get('spark.checkpoint.dir')}/slots"
    spark.createDataFrame([], SLOTS).write.mode("overwrite").parquet(path)
    text = plan(followup_cube(spark.read.parquet(path), AS_OF_EVENTS))
    assert "PushedFilters: [Or(In(status_1" in text


@pytest.mark.parametrize("name", ["school_split", "followup_counts", "coalesced_territory", "first_match_lookup"])
@pytest.mark.parametrize("settings", [{"spark.sql.shuffle.partitions": "1"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}])
def test_same_result_however_the_work_is_spread(spark, con, name, settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
