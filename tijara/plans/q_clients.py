"""Registered client queries."""

from __future__ import annotations

from ..operators import clients as CL
from . import canonical as K
from .registry import register

_RECENCY = """
    SELECT *, date_diff('day', last_order_date, (SELECT max(last_order_date) FROM customers_c)) AS recency_days
    FROM customers_c"""


@register("recency", f"""
    WITH r AS ({_RECENCY})
    SELECT customer_id, last_order_date, recency_days FROM r""", "customers_c")
def recency(spark, sf):
    c = K.canon(spark, sf)
    return CL.with_recency(c.get("customers"), c.get("orders")).select(
        "customer_id", "last_order_date", "recency_days")


@register("rfm_inputs", f"""
    WITH r AS ({_RECENCY})
    SELECT customer_id, recency_days, orders_count AS frequency, total_amount::DOUBLE AS monetary FROM r""",
          "customers_c")
def rfm_inputs(spark, sf):
    c = K.canon(spark, sf)
    return CL.rfm_inputs(c.get("customers"), c.get("orders"))


@register("rfm_readiness", f"""
    WITH r AS ({_RECENCY})
    SELECT max(last_order_date) AS reference_date, min(recency_days) AS recency_days_min,
           max(recency_days) AS recency_days_max, 'orders_count' AS frequency_field,
           'total_amount' AS monetary_field FROM r""", "customers_c")
def rfm_readiness(spark, sf):
    c = K.canon(spark, sf)
    return CL.rfm_readiness(c.get("customers"), c.get("orders"))


def _bucket_sql(x: str, th: str) -> str:
    return f"(1 + " + " + ".join(f"({x} > {th}[{i}])::INT" for i in range(1, 5)) + ")"


RFM_SQL = f"""
    WITH r AS ({_RECENCY}),
    x AS (SELECT customer_id, recency_days, orders_count AS frequency, total_amount::DOUBLE AS monetary FROM r),
    th AS (SELECT quantile_disc(recency_days, [0.2, 0.4, 0.6, 0.8]) AS rt,
                  quantile_disc(frequency, [0.2, 0.4, 0.6, 0.8]) AS ft,
                  quantile_disc(monetary, [0.2, 0.4, 0.6, 0.8]) AS mt FROM x),
    s AS (SELECT customer_id, 6 - {_bucket_sql('recency_days', 'rt')} AS r_score,
                 {_bucket_sql('frequency', 'ft')} AS f_score, {_bucket_sql('monetary', 'mt')} AS m_score
          FROM x, th)
    SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
                   WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
                   WHEN r_score = 1 AND f_score <= 2 THEN 'Lost' ELSE 'Others' END AS segment
    FROM s"""


@register("rfm_segments", RFM_SQL, "customers_c")
def rfm_segments(spark, sf):
    c = K.canon(spark, sf)
    return CL.rfm_segments(c.get("customers"), c.get("orders"))


@register("rfm_segment_summary", f"""
    WITH seg AS ({RFM_SQL})
    SELECT segment, count(*) AS customers, sum(c.total_amount)::DOUBLE AS monetary
    FROM seg JOIN customers_c c USING (customer_id) GROUP BY 1""", "customers_c")
def rfm_segment_summary(spark, sf):
    c = K.canon(spark, sf)
    cust = c.get("customers")
    return CL.rfm_segment_summary(CL.rfm_segments(cust, c.get("orders")), cust)


def _valid_dim(spark, sf):
    c = K.canon(spark, sf)
    return K.realized(c.get("orders")), K.customer_dim(c.t)


@register("clients_by_region", """
    SELECT region AS label, count(DISTINCT customer_id) AS customers
    FROM orders_cust_c WHERE status_code IN ('F', 'P') AND region IS NOT NULL GROUP BY 1""", "orders_cust_c")
def clients_by_region(spark, sf):
    return CL.clients_by_region(*_valid_dim(spark, sf))


@register("clients_by_type", """
    SELECT customer_type AS label, count(DISTINCT customer_id) AS customers,
           sum(order_total_amount)::DOUBLE AS revenue, count(order_id) AS orders
    FROM orders_cust_c WHERE status_code IN ('F', 'P') AND customer_type IS NOT NULL GROUP BY 1""",
          "orders_cust_c")
def clients_by_type(spark, sf):
    return CL.clients_by_type(*_valid_dim(spark, sf))


@register("clients_total", """
    SELECT count(DISTINCT customer_id) AS total_clients FROM realized_c""", "realized_c")
def clients_total(spark, sf):
    return CL.clients_total(K.realized(K.canon(spark, sf).get("orders")))
