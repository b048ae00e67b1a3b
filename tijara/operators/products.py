"""Product KPIs over order lines (O-4.2, O-6.8 .. O-6.13, O-9.1).

``lines`` carries sku, product_name, category, line_total, quantity,
unit_price, order_id and sku_quality.  Only reliable catalogue matches
(``sku_quality = 'ok'``) count, over orders of every status (D8, as the source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from .common import sku_rollup


def reliable(lines: DataFrame) -> DataFrame:
    """O-4.2."""
    return lines.filter(F.col("sku_quality") == "ok")


def _revenue():
    return F.sum("line_total").cast("double").alias("revenue")


def rank_products(lines: DataFrame, products: DataFrame, n: int = 10, ascending: bool = False) -> DataFrame:
    """O-6.8 / O-6.9 + O-9.1 / O-4.10: top (or bottom) n products by revenue.

    ``line_count`` counts lines (D10).  Lines are rolled up per SKU before the
    product join.  Ties break on the product name.  The limit is the feature
    (a top-n report): Spark plans it as a per-partition top-n followed by a
    merge (TakeOrderedAndProject), not a full sort."""
    r = sku_rollup(reliable(lines), products, _rev=F.sum("line_total"), _n=F.count("order_id"))
    agg = (r.filter(F.col("product_name").isNotNull())
           .groupBy("product_name").agg(F.sum("_rev").cast("double").alias("revenue"),
                                        F.sum("_n").alias("line_count")))
    rev = F.col("revenue").asc() if ascending else F.col("revenue").desc()
    return agg.orderBy(rev, F.col("product_name").asc()).limit(n)


def by_category(lines: DataFrame, key: str = "category") -> DataFrame:
    """O-6.10 + O-9.2: revenue and distinct orders per category, fully sorted
    by revenue (a small result)."""
    return (reliable(lines).filter(F.col(key).isNotNull())
            .groupBy(key).agg(_revenue(), F.countDistinct("order_id").alias("orders"))
            .orderBy(F.col("revenue").desc(), F.col(key)))


def by_subcategory(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """O-5.2 + O-6.11: replace the line's category/subcategory with the clean
    catalogue's (left join on sku), then as O-6.10."""
    cat = catalogue.filter(F.col("sku").isNotNull()).select("sku", "category", "subcategory") \
        .groupBy("sku").agg(F.min_by(F.struct("category", "subcategory"),
                                     F.struct("category", "subcategory")).alias("c")) \
        .select("sku", "c.*")
    ln = reliable(lines).drop("category", "subcategory").join(cat, "sku", "left")
    return by_category(ln.withColumn("sku_quality", F.lit("ok")), "subcategory")


def product_quantity(lines: DataFrame) -> DataFrame:
    """O-6.12: units, mean quantity per line (named per order in the source)
    and distinct orders per product."""
    return (reliable(lines).filter(F.col("product_name").isNotNull())
            .groupBy("product_name")
            .agg(F.sum("quantity").alias("total_units_sold"),
                 (F.sum("quantity") / F.count("quantity")).alias("avg_quantity_per_order"),
                 F.countDistinct("order_id").alias("number_of_orders")))


def price_volume(lines: DataFrame, products: DataFrame) -> DataFrame:
    """O-6.13: units, mean unit price (exact decimal sum / count) and revenue;
    lines rolled up per SKU before the product join."""
    r = sku_rollup(reliable(lines), products, _q=F.sum("quantity"), _p=F.sum("unit_price"),
                   _c=F.count("unit_price"), _rev=F.sum("line_total"))
    return (r.filter(F.col("product_name").isNotNull())
            .groupBy("product_name")
            .agg(F.sum("_q").alias("total_units_sold"),
                 (F.sum("_p").cast("double") / F.sum("_c").cast("double")).alias("avg_price"),
                 F.sum("_rev").cast("double").alias("revenue")))


def price_volume_corr(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Summary of O-6.13: correlation of mean price and units across products."""
    return price_volume(lines, products).agg(round_dp(F.corr("avg_price", "total_units_sold"), 9).alias("price_units_corr"),
                                   F.count("*").alias("products"))


def return_rate(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Declared (△) return rate per product: returned lines / lines."""
    r = sku_rollup(reliable(lines), products, _r=F.count_if("returned"), _n=F.count("*"))
    return (r.filter(F.col("product_name").isNotNull())
            .groupBy("product_name")
            .agg(F.sum("_r").alias("returned_lines"), F.sum("_n").alias("lines"))
            .withColumn("return_rate", F.col("returned_lines").cast("double") / F.col("lines").cast("double")))
