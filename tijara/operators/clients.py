"""Client analytics: recency, RFM inputs, quintile RFM segments, client pages
(O-7.1 .. O-7.3, O-12.4, O-12.5).

Input ``customers``: one row per customer with ``last_order_date``,
``orders_count``, ``total_amount`` (as stored by the loader).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_shared
from .common import customer_rollup
from .quantiles import quantiles

QUINTILES = [0.2, 0.4, 0.6, 0.8]


def reference_date(customers: DataFrame, orders: DataFrame | None = None) -> Column:
    """Latest last-order date over all customers.  With the order facts at
    hand it is read from one pruned column of ``orders`` (equal under the
    order -> customer key) instead of re-deriving the customer table."""
    if orders is not None:
        return orders.agg(F.max("order_date").cast("date")).scalar()
    return customers.agg(F.max("last_order_date")).scalar()


def with_recency(customers: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """O-7.1: days from each customer's last order to the latest last order
    over all customers (a scalar subquery, not a global window)."""
    ref = reference_date(customers, orders)
    return customers.withColumn("recency_days", F.datediff(ref, F.col("last_order_date")).cast("bigint"))


def rfm_inputs(customers: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """O-7.2: recency, frequency = orders_count, monetary = total_amount."""
    return with_recency(customers, orders).select(
        "customer_id", "recency_days", F.col("orders_count").alias("frequency"),
        F.col("total_amount").cast("double").alias("monetary"))


def rfm_readiness(customers: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """O-12.5: reference date, recency range and the fields used."""
    r = with_recency(customers, orders)
    return r.agg(F.max("last_order_date").alias("reference_date"),
                 F.min("recency_days").alias("recency_days_min"),
                 F.max("recency_days").alias("recency_days_max"),
                 F.lit("orders_count").alias("frequency_field"),
                 F.lit("total_amount").alias("monetary_field"))


def _bucket(x: Column, th: Column) -> Column:
    """1 + number of thresholds strictly below ``x`` (1..5); null stays null."""
    below = F.lit(1)
    for i in range(len(QUINTILES)):
        below = below + F.when(x > th[i], 1).otherwise(0)
    return F.when(x.isNotNull(), below)


def rfm_segments(customers: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """O-7.3 (declared; thresholds ours, SURVEY §7.6): quintile scores from
    exact thresholds (distributed ranks), then a ``when`` chain.
    Champions R>=4,F>=4,M>=4; At Risk R<=2,F>=3; Lost R=1,F<=2; else Others."""
    x = write_shared(rfm_inputs(customers, orders), "rfm-inputs")  # read for the thresholds and for the scores
    fields = ["recency_days", "frequency", "monetary"]
    q = quantiles(x.select(*[F.col(c).cast("double") for c in fields]).unpivot([], fields, "field", "value"),
                  ["field"], F.col("value"), QUINTILES, linear=False)
    th = q.agg(F.struct(*[F.max(F.when(F.col("field") == c, F.col("q"))).alias(c[0]) for c in fields])).scalar()
    r_th, f_th, m_th = th["r"], th["f"], th["m"]
    s = x.select("customer_id",
                 (F.lit(6) - _bucket(F.col("recency_days"), r_th)).alias("r_score"),
                 _bucket(F.col("frequency"), f_th).alias("f_score"),
                 _bucket(F.col("monetary"), m_th).alias("m_score"))
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    seg = (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
           .when((r <= 2) & (f >= 3), "At Risk")
           .when((r == 1) & (f <= 2), "Lost")
           .otherwise("Others"))
    return s.withColumn("segment", seg)


def rfm_segment_summary(segments: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers and monetary value per segment."""
    return (segments.join(customers.select("customer_id", "total_amount"), "customer_id")
            .groupBy("segment")
            .agg(F.count("*").alias("customers"), F.sum("total_amount").cast("double").alias("monetary")))


def clients_by_region(valid_orders: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """O-12.4 wilaya_distribution: distinct realized customers per region
    (orders rolled up per customer before the join)."""
    r = customer_rollup(valid_orders, customer_dim, _n=F.count("order_id"))
    return (r.filter(F.col("region").isNotNull()).groupBy(F.col("region").alias("label"))
            .agg(F.count("customer_id").alias("customers")))


def clients_by_type(valid_orders: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """O-12.4 customer_types: customers, revenue and orders per type."""
    r = customer_rollup(valid_orders, customer_dim, _rev=F.sum("order_total_amount"), _n=F.count("order_id"))
    return (r.filter(F.col("customer_type").isNotNull())
            .groupBy(F.col("customer_type").alias("label"))
            .agg(F.count("customer_id").alias("customers"),
                 F.sum("_rev").cast("double").alias("revenue"),
                 F.sum("_n").alias("orders")))


def clients_total(valid_orders: DataFrame) -> DataFrame:
    """total_clients: customers with at least one realized order (§7.6)."""
    return valid_orders.agg(F.countDistinct("customer_id").alias("total_clients"))
