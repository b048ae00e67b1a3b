"""Drill-down table: levels, missing labels, one scan."""
import datetime as dt

from tijara.operators import drilldown as D


def _frames(spark):
    orders = spark.createDataFrame([(1, 10, "card", dt.datetime(2024, 1, 3), 5), (2, 10, "cash", dt.datetime(2024, 1, 9), 7), (3, 11, "card", dt.datetime(2024, 2, 1), 11),
                                    (4, 12, None, dt.datetime(2024, 2, 2), 13)],
                                   "order_id long, customer_id long, payment_method_group string, order_date timestamp, order_total_amount long")
    orders = orders.withColumn("order_total_amount", orders.order_total_amount.cast("decimal(12,2)"))
    dim = spark.createDataFrame([(10, "N", "a"), (11, None, "a"), (12, "S", "b")], "customer_id long, region string, customer_type string")
    return orders, dim


def test_levels_tell_a_missing_label_from_a_sum(spark):
    rows = D.cube(*_frames(spark)).collect()
    at = lambda *dims: [r for r in rows if r.level == D.level(dims)]
    assert [(r.revenue, r.orders, r.clients, r.average_basket) for r in at()] == [(36.0, 4, 3, 9.0)]
    assert {(r.region, r.revenue, r.clients) for r in at("region")} == {("N", 12.0, 1), (None, 11.0, 1), ("S", 13.0, 1)}
    assert {(r.payment, r.orders) for r in at("payment")} == {("card", 2), ("cash", 1), (None, 1)}
    assert {(r.region, str(r.month), r.revenue) for r in at("region", "month")} == {("N", "2024-01-01", 12.0), (None, "2024-02-01", 11.0), ("S", "2024-02-01", 13.0)}
    assert {r.level for r in rows} == {D.level(s) for s in D.SETS} and len(D.SETS) == 11


def test_drill_down_is_a_filter(spark):
    from pyspark.sql import functions as F
    table = D.cube(*_frames(spark))
    got = {(r.by, r.label, r.revenue) for r in D.drill_down(table, "customer_type", F.lit("a")).collect()}
    assert got == {("customer_type", "a", 23.0), ("region", "N", 12.0), ("region", None, 11.0), ("payment", "card", 16.0), ("payment", "cash", 7.0),
                   ("month", "2024-01-01", 12.0), ("month", "2024-02-01", 11.0)}
    assert {r.label for r in D.labels(table, "region").collect()} == {"N", None, "S"}


def test_one_scan_of_the_facts(spark, tmp_path):
    orders, dim = _frames(spark)
    orders.write.parquet(str(tmp_path / "o"))
    plan = D.cube(spark.read.parquet(str(tmp_path / "o")), dim)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
