"""Every query against its SQL."""

import pytest
from helpers import oracle, same_rows
from tillroll.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, small, name):
    same_rows(registry.QUERIES[name](spark, small), oracle(small).sql(registry.SQL[name]))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["transaction_id", "final_amount"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, small):
    plan = registry.q1_events(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "GreaterThanOrEqual(value" in plan
    assert "Exchange" not in plan


def test_top_k_is_limited_before_the_shuffle(spark, small):
    plan = registry.q4_top3_users(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["q3_tpv", "q4_top3_users", "agg_tpv", "agg_purchases"])
def test_no_join_of_facts(spark, small, name):
    """Facts are aggregated before they meet a dimension, whatever kind of join it is."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "o_custkey" in line and "Relation" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line.lstrip(" :+-").split()[0])
            at = depth(line)
    assert above.index("Aggregate") < above.index("Join")
