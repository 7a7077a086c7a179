"""Every registered query beside its SQL at sf0.01."""

from __future__ import annotations

import pytest
from compare import compared, connection

from loomshed import plans

plans.load()
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, con, name):
    assert compared(spark, con, FOLDER, plans.QUERIES[name], plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    """Filters and columns reach the scan; a top-k isn't a sort; a bucketed join doesn't shuffle."""
    plan = lambda n: plans.QUERIES[n](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scan = plan("tpch_forecast_revenue")
    assert "PushedFilters: [IsNotNull" in scan and "l_comment" not in scan and "l_returnflag" not in scan
    assert "TakeOrderedAndProject" in plan("sort_limit_offset")
    assert "WindowGroupLimit" in plan("window_qualify_top")
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan("partitioned_read")
    assert "Exchange hashpartitioning" not in plan("bucketed_join")
    assert "BroadcastNestedLoopJoin" not in plan("join_range_band")
    assert "Window " not in plan("window_qualify_mean") and "LeftAnti" in plan("subquery_not_in") and "LeftAnti, BuildRight, true" not in plan("subquery_not_in")


def test_sample_has_its_share_and_comes_again(spark):
    whole = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    runs = [sorted(map(str, plans.QUERIES["sample_rows"](spark, FOLDER).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and abs(len(runs[0]) - 0.1 * whole) < 5 * (0.09 * whole) ** 0.5
