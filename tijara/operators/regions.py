"""Region (wilaya) analytics (O-4.4, O-4.8, O-5.5, O-6.14 .. O-6.16, O-7.4, O-12.6).

Input: order facts and the customer dimension with its geography
(``region_id``, ``region``, ``region_code``, ``geography_status``,
``latitude``, ``longitude``).  Orders are rolled up per customer before the
join; every result is one fused aggregation per region; totals and reference dates are
scalar subqueries (computed once, broadcast as a value) -- never an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from ..functions import cleaning as C
from ..functions import rules
from .common import customer_rollup


def region_ranking(orders: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """O-6.14 + O-6.15 + O-6.16 fused into one groupBy (O-5.5: no join of two
    results); orders are rolled up per customer before meeting the customer
    dimension, so active customers are the rollup rows per region."""
    r = customer_rollup(orders, customer_dim, _rev=F.sum("order_total_amount"))
    return (r.filter(F.col("region").isNotNull())
            .groupBy("region")
            .agg(F.sum("_rev").cast("double").alias("revenue"), F.count("customer_id").alias("active_customers"))
            .withColumn("avg_revenue_per_customer", C.ratio("revenue", "active_customers"))
            .orderBy(F.col("revenue").desc(), "region"))


def months_before(ts: Column, months: int) -> Column:
    """Calendar offset keeping the time of day, day clamped to month end."""
    return ts - F.make_interval(F.lit(0), F.lit(months))


def region_decline(orders: DataFrame, customer_dim: DataFrame, months: int = 3) -> DataFrame:
    """O-4.4 + O-7.4: revenue in the last ``months`` before the latest order
    vs the ``months`` before that, per region; growth and a decline flag.
    The reference date is one pruned column of the order facts."""
    d_max = orders.agg(F.max("order_date")).scalar()
    recent_start = months_before(d_max, months)
    previous_start = months_before(d_max, 2 * months)
    d = F.col("order_date")
    amt = F.col("order_total_amount")
    r = customer_rollup(orders, customer_dim,
                        _r=F.sum(F.when(d >= recent_start, amt)),
                        _p=F.sum(F.when((d >= previous_start) & (d < recent_start), amt)))
    out = (r.filter(F.col("region").isNotNull()).groupBy("region")
           .agg(F.coalesce(F.sum("_r"), F.lit(0)).cast("double").alias("recent_revenue"),
                F.coalesce(F.sum("_p"), F.lit(0)).cast("double").alias("previous_revenue")))
    return (out.withColumn("growth_pct", C.growth_pct("recent_revenue", "previous_revenue"))
            .withColumn("is_declining", F.col("recent_revenue") < F.col("previous_revenue")))


def complete_month_cutoff(max_date: Column) -> Column:
    """Last month whose final day is on or before ``max_date`` (O-8.16)."""
    return F.add_months(F.trunc(F.date_add(max_date.cast("date"), 1), "MM"), -1)


GEO_COLS = ["region_id", "region_code", "region", "geography_status", "latitude", "longitude"]


def region_page(orders: DataFrame, customer_dim: DataFrame) -> DataFrame:
    """O-12.6: per region revenue, orders, clients, share of the valid-region
    total, growth of the last complete month vs the month before, and
    geography fields.  Orders are rolled up per customer before the join; the
    share's total is summed from the per-region result (its exchange is
    reused) and the cutoff comes from the order dates alone."""
    cutoff = complete_month_cutoff(orders.agg(F.max("order_date")).scalar())
    prev = F.add_months(cutoff, -1)
    m = C.month_start("order_date")
    amt = F.col("order_total_amount")
    r = customer_rollup(orders, customer_dim, _rev=F.sum(amt), _n=F.count("order_id"),
                        _cur=F.sum(F.when(m == cutoff, amt)), _prev=F.sum(F.when(m == prev, amt)))
    g = (r.groupBy(*GEO_COLS)
         .agg(F.sum("_rev").alias("_rev"), F.sum("_n").alias("orders"), F.count("customer_id").alias("clients"),
              F.sum("_cur").alias("_cur"), F.sum("_prev").alias("_prev")))
    total = g.filter(F.col("geography_status") == "valid_wilaya").agg(F.sum("_rev")).scalar()
    return g.select(
        F.col("region_code").alias("id"), F.col("region").alias("label"),
        F.col("_rev").cast("double").alias("revenue"), "orders", "clients",
        (F.col("_rev").cast("double") / total.cast("double") * 100.0).alias("share"),
        C.growth_pct(F.coalesce(F.col("_cur"), F.lit(0)), F.coalesce(F.col("_prev"), F.lit(0))).alias("growth"),
        "geography_status", "latitude", "longitude")


def valid_geography(page: DataFrame) -> DataFrame:
    """O-4.8 + bubble/shade scaling: keep regions with valid status, finite
    coordinates and revenue >= 0; radius 7 + 21*min(sqrt(rev/max), 1)."""
    ok = ((F.col("geography_status") == "valid_wilaya") & ~F.isnan("latitude") & ~F.isnan("longitude")
          & ~F.isnan("revenue") & (F.col("revenue") >= 0))
    v = page.filter(ok)
    mx = v.agg(F.max("revenue")).scalar()
    radius = F.when(mx <= 0, F.lit(rules.BUBBLE_MIN_RADIUS)).otherwise(
        F.lit(rules.BUBBLE_MIN_RADIUS) + F.lit(rules.BUBBLE_RADIUS_RANGE)
        * F.least(F.sqrt(F.col("revenue") / mx), F.lit(1.0)))
    shade = F.least(F.lit(rules.SHADE_BASE) + F.lit(rules.SHADE_PER_SHARE) * F.col("share"), F.lit(rules.SHADE_MAX))
    return v.select("id", "label", "revenue", "share", round_dp(radius, 9).alias("radius"),
                    round_dp(shade, 9).alias("shade"))


def active_regions(page: DataFrame) -> DataFrame:
    """``active_wilayas``: regions with a realized order and valid geography."""
    return page.agg(F.count_if((F.col("orders") > 0) & (F.col("geography_status") == "valid_wilaya"))
                    .alias("active_wilayas"), F.count("*").alias("regions"))
