"""Drill-down context (O-12.18): approved aggregates for every selection.

One table by grouping sets over region, customer type, payment group and month:
the total, every label of one dimension, and every pair of labels of two.  A
drill-down is a filter on it (never raw rows): the labels of one dimension, or
one label's breakdown by another.  ``level`` is the grouping id (a bit is 1
where the dimension is summed over, the first dimension's bit is the highest),
which tells a missing label from a sum.

Orders are summed per customer, payment group and month first, so the customer
dimension meets those and the sets expand sums, not orders.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C

DIMENSIONS = ("region", "customer_type", "payment", "month")
#: The total, the single dimensions, the pairs.
SETS = [s for n in (0, 1, 2) for s in itertools.combinations(DIMENSIONS, n)]


def level(dims) -> int:
    """Grouping id of the set of dimensions that are not summed over."""
    return sum(1 << (len(DIMENSIONS) - 1 - i) for i, d in enumerate(DIMENSIONS) if d not in dims)


def cube(valid_orders: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """region, customer_type, payment, month, level, revenue, orders, clients, average_basket."""
    per = (valid_orders.groupBy("customer_id", F.col("payment_method_group").alias("payment"), C.month_start("order_date").alias("month"))
           .agg(F.sum("order_total_amount").alias("_rev"), F.count("order_id").alias("_n")))
    per = per.join(customer_dim.select("customer_id", "region", "customer_type"), "customer_id", "left")
    dims = [F.col(d) for d in DIMENSIONS]
    g = per.groupingSets([[F.col(d) for d in s] for s in SETS], *dims).agg(
        F.grouping_id(*dims).cast("int").alias("level"), F.sum("_rev").alias("_rev"), F.sum("_n").alias("orders"), F.countDistinct("customer_id").alias("clients"))
    return g.select(*DIMENSIONS, "level", F.col("_rev").cast("double").alias("revenue"), "orders", "clients",
                    C.ratio(F.col("_rev"), F.col("orders")).alias("average_basket"))


def labels(table: DataFrame, dimension: str) -> DataFrame:
    """Metrics of every label of one dimension."""
    return table.filter(F.col("level") == level((dimension,))).select(F.col(dimension).alias("label"), "revenue", "orders", "clients", "average_basket")


def drill_down(table: DataFrame, dimension: str, selection: Column) -> DataFrame:
    """by, label, metrics: a selected label's own row (by = its dimension) and its breakdowns by the other dimensions."""
    chosen = table.filter(F.col(dimension) == selection)
    out = None
    for other in DIMENSIONS:
        dims = (dimension,) if other == dimension else (dimension, other)
        part = chosen.filter(F.col("level") == level(dims)).select(
            F.lit(other).alias("by"), F.col(other).cast("string").alias("label"), "revenue", "orders", "clients", "average_basket")
        out = part if out is None else out.unionByName(part)
    return out
