"""Plan-level guarantees for scale (checked on the optimized / executed plans)."""
import re

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tijara.plans import canonical as K
from tijara.sources.tables import checked_broadcast

Q = E.queries()


def executed(spark, name):
    df = Q[name](spark, SF_SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_realized_filter_reaches_the_scan(spark):
    for name in ["sales_by_payment", "monthly_revenue", "overview_kpis", "region_page"]:
        plan = executed(spark, name)
        assert "PushedFilters: [In(o_orderstatus, [F,P])" in plan, name


def test_scans_read_only_needed_columns(spark):
    plan = executed(spark, "sales_by_payment")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("o_custkey" not in s and "o_orderdate" not in s for s in schemas)


def test_broadcast_only_with_a_proven_bound(spark):
    c = K.canon(spark, SF_SMALL)
    small = checked_broadcast(c.t.nation, 1024)
    big = checked_broadcast(c.t.lineitem, 100)  # more rows than the bound: no hint
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in big._jdf.queryExecution().analyzed().toString().lower()


def test_panels_use_equi_joins(spark):
    for name in ["acf_by_region", "decompose_additive_by_region", "fc_baseline_metrics_by_region"]:
        plan = executed(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_cartesian_outside_the_global_series(spark):
    for name in ["sales_by_delivery", "region_ranking", "clients_by_type", "prep_metrics", "scope", "sales_page"]:
        plan = executed(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_region_rollup_joins_per_customer_rows(spark):
    # the customer join's order side is an aggregate keyed by customer (rollup before join)
    df = Q["region_ranking"](spark, SF_SMALL)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[customer_id#\d+L\]", opt)
