"""Every query that has a SQL form, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle import assert_same, connection
from wayfold.plans import models, mobility, streams
from wayfold.session import prepare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


assert streams.QUERIES is mobility.QUERIES


@pytest.mark.parametrize("name", sorted(mobility.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert_same(mobility.QUERIES[name](prepare(spark), SF).toPandas(), duck.sql(mobility.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(models.QUERIES) - set(mobility.ORACLE) - {"calibrate", "detect_agents", "agent_dglm", "agent_dglm_resume", "oam_pm", "oam_pm_summary", "inject_anomaly"}))
def test_query_without_sql_has_rows(spark, name):
    assert models.QUERIES[name](prepare(spark), SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_prepare_takes_a_session_without_a_time_zone(spark):
    fresh = spark.newSession()
    fresh.conf.unset("spark.sql.session.timeZone")
    assert prepare(fresh).conf.get("spark.sql.session.timeZone") == "UTC"


def test_panels_are_not_broadcast_by_estimates(spark, duck):
    """An estimate takes an exploded panel for its positions' few columns; only sizes measured at run time may decide."""
    import __spark_entry__

    own = spark.newSession()
    most = own.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("kstep_feature_compat", "kstep_feature"):
        made = __spark_entry__.queries()[name](own, SF)
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
        assert_same(made.toPandas(), duck.sql(mobility.ORACLE[name]).df())
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == most
