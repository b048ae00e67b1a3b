"""Registered region queries."""

from __future__ import annotations

from ..operators import regions as R
from . import canonical as K
from .registry import register


def _orders_dim(spark, sf, realized: bool):
    """(order facts, customer dimension with geography)."""
    c = K.canon(spark, sf)
    o = c.get("orders")
    return (K.realized(o) if realized else o), K.customer_dim(c.t)


@register("region_ranking", """
    SELECT region, sum(order_total_amount)::DOUBLE AS revenue, count(DISTINCT customer_id) AS active_customers,
           sum(order_total_amount)::DOUBLE / nullif(count(DISTINCT customer_id), 0)::DOUBLE AS avg_revenue_per_customer
    FROM orders_cust_c WHERE region IS NOT NULL GROUP BY 1""", "orders_cust_c")
def region_ranking(spark, sf):
    return R.region_ranking(*_orders_dim(spark, sf, realized=False))


@register("region_ranking_realized", """
    SELECT region, sum(order_total_amount)::DOUBLE AS revenue, count(DISTINCT customer_id) AS active_customers,
           sum(order_total_amount)::DOUBLE / nullif(count(DISTINCT customer_id), 0)::DOUBLE AS avg_revenue_per_customer
    FROM orders_cust_c WHERE region IS NOT NULL AND status_code IN ('F', 'P') GROUP BY 1""", "orders_cust_c")
def region_ranking_realized(spark, sf):
    """D9: the ranking over realized orders only."""
    return R.region_ranking(*_orders_dim(spark, sf, realized=True))


@register("region_decline", """
    WITH mx AS (SELECT max(order_date) AS d FROM orders_cust_c),
    g AS (SELECT region,
           coalesce(sum(CASE WHEN order_date >= d - INTERVAL 3 MONTH THEN order_total_amount END), 0)::DOUBLE
             AS recent_revenue,
           coalesce(sum(CASE WHEN order_date >= d - INTERVAL 6 MONTH AND order_date < d - INTERVAL 3 MONTH
                             THEN order_total_amount END), 0)::DOUBLE AS previous_revenue
          FROM orders_cust_c, mx WHERE region IS NOT NULL GROUP BY region)
    SELECT region, recent_revenue, previous_revenue,
           (recent_revenue - previous_revenue) / nullif(previous_revenue, 0) * 100.0 AS growth_pct,
           recent_revenue < previous_revenue AS is_declining
    FROM g""", "orders_cust_c")
def region_decline(spark, sf):
    return R.region_decline(*_orders_dim(spark, sf, realized=False))


REGION_PAGE_SQL = """
    WITH o AS (SELECT * FROM orders_cust_c WHERE status_code IN ('F', 'P')),
    cut AS (SELECT date_trunc('month', CAST(max(order_date) AS DATE) + 1) - INTERVAL 1 MONTH AS cm FROM o),
    tot AS (SELECT sum(order_total_amount)::DOUBLE AS t FROM o WHERE geography_status = 'valid_wilaya'),
    g AS (SELECT region_id, region_code, region, geography_status, latitude, longitude,
                 sum(order_total_amount) AS rev, count(order_id) AS orders, count(DISTINCT customer_id) AS clients,
                 coalesce(sum(CASE WHEN date_trunc('month', order_date) = cm THEN order_total_amount END), 0)::DOUBLE AS cur,
                 coalesce(sum(CASE WHEN date_trunc('month', order_date) = cm - INTERVAL 1 MONTH
                                   THEN order_total_amount END), 0)::DOUBLE AS prv
          FROM o, cut GROUP BY ALL)
    SELECT region_code AS id, region AS label, rev::DOUBLE AS revenue, orders, clients,
           rev::DOUBLE / (SELECT t FROM tot) * 100.0 AS share,
           (cur - prv) / nullif(prv, 0) * 100.0 AS growth, geography_status, latitude, longitude
    FROM g"""


@register("region_page", REGION_PAGE_SQL, "orders_cust_c")
def region_page(spark, sf):
    return R.region_page(*_orders_dim(spark, sf, realized=True))


@register("valid_geography", f"""
    WITH p AS ({REGION_PAGE_SQL}),
    v AS (SELECT * FROM p WHERE geography_status = 'valid_wilaya' AND NOT isnan(latitude)
          AND NOT isnan(longitude) AND NOT isnan(revenue) AND revenue >= 0),
    mx AS (SELECT max(revenue) AS m FROM v)
    SELECT id, label, revenue, share,
           round(CASE WHEN m <= 0 THEN 7.0 ELSE 7.0 + 21.0 * least(sqrt(revenue / m), 1.0) END, 9) AS radius,
           round(least(38.0 + 2.25 * share, 88.0), 9) AS shade
    FROM v, mx""", "orders_cust_c")
def valid_geography(spark, sf):
    return R.valid_geography(R.region_page(*_orders_dim(spark, sf, realized=True)))


@register("active_regions", f"""
    WITH p AS ({REGION_PAGE_SQL})
    SELECT count_if(orders > 0 AND geography_status = 'valid_wilaya') AS active_wilayas, count(*) AS regions
    FROM p""", "orders_cust_c")
def active_regions(spark, sf):
    return R.active_regions(R.region_page(*_orders_dim(spark, sf, realized=True)))
