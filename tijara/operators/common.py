"""Shared building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def customer_rollup(orders: DataFrame, customer_dim: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregate before join: orders reduced to one row per customer (a
    partial aggregation on the order side), then joined to the customer
    dimension.  The join sees one row per active customer instead of one per
    order, and per-region / per-type measures that are sums, counts or the
    number of distinct customers stay exact (one rollup row per customer)."""
    per = orders.groupBy("customer_id").agg(*[c.alias(name) for name, c in aggs.items()])
    return per.join(customer_dim, "customer_id")


def sku_rollup(lines: DataFrame, products: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregate before join on the product side: lines reduced to one row per
    SKU, then joined (left) to the product attributes.  Valid for measures
    that decompose over SKUs (sums and counts)."""
    per = lines.groupBy("sku").agg(*[c.alias(name) for name, c in aggs.items()])
    return per.join(products, "sku", "left")
