"""Registered sales queries."""

from __future__ import annotations

from ..operators import sales as S
from . import canonical as K
from .oracle import status_group_sql
from .registry import register

_KPI_SQL = """
    sum(order_total_amount)::DOUBLE AS revenue, count(order_id) AS orders,
    sum(order_total_amount)::DOUBLE / count(order_total_amount)::DOUBLE AS average_basket"""


@register("sales_by_payment", f"""
    SELECT payment_method_group AS label, {_KPI_SQL}
    FROM realized_c WHERE payment_method_group IS NOT NULL GROUP BY 1""", "realized_c")
def sales_by_payment(spark, sf):
    c = K.canon(spark, sf)
    return S.kpis_by(K.realized(c.get("orders")), "payment_method_group")


@register("sales_total", """
    SELECT coalesce(sum(order_total_amount), 0)::DOUBLE AS revenue, count(*) AS orders FROM realized_c""",
          "realized_c")
def sales_total(spark, sf):
    return S.sales_total(K.realized(K.canon(spark, sf).get("orders")))


@register("sales_by_delivery", """
    SELECT m.shipping_method AS label, sum(o.order_total_amount)::DOUBLE AS revenue,
           count(DISTINCT o.order_id) AS orders,
           sum(o.order_total_amount)::DOUBLE / count(o.order_total_amount)::DOUBLE AS average_basket
    FROM realized_c o LEFT JOIN (SELECT DISTINCT order_id, shipping_method FROM lines_c) m USING (order_id)
    WHERE m.shipping_method IS NOT NULL GROUP BY 1""", "realized_c", "lines_c")
def sales_by_delivery(spark, sf):
    c = K.canon(spark, sf)
    return S.sales_by_delivery(K.realized(c.get("orders")), c.get("lines"))


@register("sales_by_customer_type", """
    SELECT customer_type AS label, count(DISTINCT customer_id) AS customers,
           sum(order_total_amount)::DOUBLE AS revenue, count(order_id) AS orders,
           sum(order_total_amount)::DOUBLE / nullif(count(order_id), 0)::DOUBLE AS average_basket
    FROM orders_cust_c WHERE status_code IN ('F', 'P') AND customer_type IS NOT NULL GROUP BY 1""",
          "orders_cust_c")
def sales_by_customer_type(spark, sf):
    c = K.canon(spark, sf)
    return S.sales_by_customer_type(K.realized(c.get("orders")), K.customer_dim(c.t))


@register("status_mix", f"""
    WITH m AS (SELECT order_id, {status_group_sql('order_status')} AS sales_status FROM orders_c),
         g AS (SELECT sales_status, count(order_id) AS orders_count FROM m
               WHERE sales_status IS NOT NULL GROUP BY 1)
    SELECT sales_status, orders_count,
           round(orders_count::DOUBLE / (SELECT sum(orders_count) FROM g)::DOUBLE * 100.0, 2) AS percentage
    FROM g""", "orders_c")
def status_mix(spark, sf):
    return S.status_mix(K.canon(spark, sf).get("orders"))


@register("status_unmapped", f"""
    SELECT count_if({status_group_sql('order_status')} IS NULL) AS unmapped_orders, count(*) AS all_orders
    FROM orders_c""", "orders_c")
def status_unmapped(spark, sf):
    return S.status_unmapped(K.canon(spark, sf).get("orders"))


def _flag_sql(flag: str) -> str:
    return f"""
    WITH f AS (SELECT order_id, coalesce(bool_or({flag}), false) AS fl FROM lines_c GROUP BY 1)
    SELECT coalesce(f.fl, false) AS flag, sum(o.order_total_amount)::DOUBLE AS total_revenue,
           count(DISTINCT o.order_id) AS total_orders,
           sum(o.order_total_amount)::DOUBLE / count(o.order_total_amount)::DOUBLE AS average_order_value
    FROM realized_c o LEFT JOIN f USING (order_id) GROUP BY 1"""


@register("flag_impact_negative", _flag_sql("has_negative_price"), "realized_c", "lines_c")
def flag_impact_negative(spark, sf):
    c = K.canon(spark, sf)
    return S.flag_impact(K.realized(c.get("orders")), c.get("lines"), "has_negative_price")


@register("flag_impact_free_shipping", _flag_sql("free_shipping"), "realized_c", "lines_c")
def flag_impact_free_shipping(spark, sf):
    c = K.canon(spark, sf)
    return S.flag_impact(K.realized(c.get("orders")), c.get("lines"), "free_shipping")


@register("customer_avg_basket", """
    SELECT customer_id, orders_count, total_amount::DOUBLE AS total_amount,
           total_amount::DOUBLE / nullif(orders_count, 0)::DOUBLE AS average_basket
    FROM customers_c""", "customers_c")
def customer_avg_basket(spark, sf):
    return S.customer_avg_basket(K.canon(spark, sf).get("customers"))
