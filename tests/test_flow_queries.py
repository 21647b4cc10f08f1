"""Every registered flow query against its SQL."""

import pytest

import __spark_entry__
from flowloom.plans.queries import ORACLES, QUERIES
from tests.oracle import TABLES, assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], {t: f"{sf}/{t}.parquet" for t in TABLES})


def test_whole_chains_need_no_join(spark, sf):
    plan = QUERIES["flow_chain"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Relation") == 2  # packets, and the sums of their offsets


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
