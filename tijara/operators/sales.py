"""Sales KPIs over the realized-order population (O-6.1 .. O-6.7, O-3.12, O-3.21).

Money is summed as decimal (exact, order-independent) and reported as double.
Means are ``sum / count`` of those exact values, never an average of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from ..functions import cleaning as C
from ..sources.tables import checked_broadcast
from .common import customer_rollup

# Distinct raw labels up to which the class table is broadcast.
MAX_LABELS = 10_000


def _money_kpis(amount: str = "order_total_amount", order: str = "order_id",
                names=("revenue", "orders", "average_basket"), distinct_orders: bool = True) -> list[Column]:
    rev, n_orders, avg = names
    s = F.sum(amount)
    return [s.cast("double").alias(rev),
            (F.countDistinct(order) if distinct_orders else F.count(order)).alias(n_orders),
            (s.cast("double") / F.count(amount).cast("double")).alias(avg)]


def sales_total(valid_orders: DataFrame) -> DataFrame:
    """O-6.1: total realized revenue (and the order count behind it)."""
    return valid_orders.agg(F.coalesce(F.sum("order_total_amount"), F.lit(0)).cast("double").alias("revenue"),
                            F.count("*").alias("orders"))


def kpis_by(valid_orders: DataFrame, key: str, label: str = "label") -> DataFrame:
    """O-6.2: revenue, distinct orders and mean amount per group; null keys dropped.

    Orders are unique after key dedupe (O-3.19), so the order count is a plain
    count -- one aggregation, fully partial (map-side) before the shuffle."""
    return (valid_orders.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(label))
            .agg(*_money_kpis(distinct_orders=False)))


def orders_by_shipping(valid_orders: DataFrame, lines: DataFrame) -> DataFrame:
    """O-5.3 fan-out: each order joined to its distinct shipping methods.

    The distinct (order, method) set is built as one ``collect_set`` per order
    (bounded by the number of classes), so both join sides are partitioned by
    order id and the join needs no further exchange of the line side.  Raw
    labels are classified once per distinct label, not once per line."""
    if "shipping_label" in lines.columns:
        labels = lines.select("shipping_label").distinct()
        classes = checked_broadcast(labels.select(F.col("shipping_label").alias("_label"),
                                                  C.shipping_class("shipping_label").alias("shipping_method")), MAX_LABELS)
        lines = lines.select("order_id", "shipping_label").join(classes, F.col("shipping_label").eqNullSafe(F.col("_label")), "left")
    per_order = lines.groupBy("order_id").agg(F.collect_set("shipping_method").alias("_methods"))
    return (valid_orders.join(per_order, "order_id", "left")
            .select("*", F.explode_outer("_methods").alias("shipping_method")).drop("_methods"))


def sales_by_delivery(valid_orders: DataFrame, lines: DataFrame) -> DataFrame:
    """O-6.3: KPIs per delivery class over the fan-out; an order with two
    classes counts fully in each (documented behaviour)."""
    fan = orders_by_shipping(valid_orders, lines).filter(F.col("shipping_method").isNotNull())
    # collect_set made (order, method) unique, so a plain count is the distinct count.
    return fan.groupBy(F.col("shipping_method").alias("label")).agg(*_money_kpis(distinct_orders=False))


def sales_by_customer_type(valid_orders: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """O-6.4: distinct customers, revenue, orders and revenue/orders per type
    (orders rolled up per customer before the join)."""
    r = customer_rollup(valid_orders, customer_dim, _rev=F.sum("order_total_amount"), _n=F.count("order_id"))
    return (r.filter(F.col("customer_type").isNotNull())
            .groupBy(F.col("customer_type").alias("label"))
            .agg(F.count("customer_id").alias("customers"),
                 F.sum("_rev").cast("double").alias("revenue"),
                 F.sum("_n").alias("orders"))
            .withColumn("average_basket", C.ratio("revenue", "orders")))


def status_mix(orders: DataFrame) -> DataFrame:
    """O-3.12 + O-6.5 (+ O-3.24 rounding): orders per status group and share (rounded 2) of the
    mapped total; unmapped statuses are reported by ``status_unmapped``."""
    mapped = (orders.select("order_id", C.status_group("order_status").alias("sales_status"))
              .filter(F.col("sales_status").isNotNull()))
    per = mapped.groupBy("sales_status").agg(F.count("order_id").alias("orders_count"))
    total = per.agg(F.sum("orders_count")).scalar()  # over the grouped result: its exchange is reused
    return per.withColumn("percentage",
                          round_dp(F.col("orders_count").cast("double") / total.cast("double") * 100.0, 2))


def status_unmapped(orders: DataFrame) -> DataFrame:
    """Count of orders whose status is outside the mapping (dropped by O-6.5)."""
    g = C.status_group("order_status")
    return orders.agg(F.count_if(g.isNull()).alias("unmapped_orders"),
                      F.count("*").alias("all_orders"))


def order_flag(lines: DataFrame, flag: str, name: str) -> DataFrame:
    """O-6.6: order-level ``any()``; nulls ignored, all-null -> false."""
    return lines.groupBy("order_id").agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(name))


def flag_impact(valid_orders: DataFrame, lines: DataFrame, flag: str) -> DataFrame:
    """O-5.4 + O-6.7: revenue, orders and mean order value split by an order-level flag.

    Lines are reduced to one row per order *before* the join (aggregate before
    join), so only |orders| rows cross the shuffle."""
    name = f"order_{flag}"
    per = order_flag(lines, flag, name)
    j = (valid_orders.join(per, "order_id", "left")
         .withColumn(name, F.coalesce(F.col(name), F.lit(False))))
    return (j.groupBy(F.col(name).alias("flag"))
            .agg(*_money_kpis(names=("total_revenue", "total_orders", "average_order_value"),
                              distinct_orders=False)))


def customer_avg_basket(customers: DataFrame) -> DataFrame:
    """O-3.21: total_amount / orders_count per customer (null on 0 orders)."""
    return customers.select("customer_id", "orders_count",
                            F.col("total_amount").cast("double").alias("total_amount"),
                            C.ratio("total_amount", "orders_count").alias("average_basket"))
