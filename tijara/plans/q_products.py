"""Registered product queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import rules
from ..operators import cleaning as CL
from ..operators import crosssell as XS
from ..operators import products as P
from . import canonical as K
from .registry import register

NORM_NAME_SQL = "trim(regexp_replace({c}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return NORM_NAME_SQL.format(c=c)


def catalogue_typed(c: K.Canon):
    """Raw catalogue renamed, typed, row-deduplicated, names normalized."""
    df = CL.rename(c.get("raw_catalogue"), rules.CATALOGUE_RENAMES)
    df = CL.normalize_names(CL.dedupe_rows(CL.cast_typed(df)))
    return df.withColumn("sku", F.col("sku").try_cast("bigint"))


def catalogue_dims(c: K.Canon):
    return (catalogue_typed(c).select("sku", "category", "subcategory")
            .withColumn("subcategory", F.coalesce(C.path_part("subcategory", 1), F.lit("Unknown"))))


_TOP_SQL = """
    SELECT product_name, sum(line_total)::DOUBLE AS revenue, count(order_id) AS line_count
    FROM lines_prod_c WHERE sku_quality = 'ok' AND product_name IS NOT NULL
    GROUP BY 1 ORDER BY revenue {dir}, product_name LIMIT 10"""


@register("top_products", _TOP_SQL.format(dir="DESC"), "lines_prod_c")
def top_products(spark, sf):
    c = K.canon(spark, sf)
    return P.rank_products(c.get("lines"), K.products(c.t), 10, ascending=False)


@register("low_products", _TOP_SQL.format(dir="ASC"), "lines_prod_c")
def low_products(spark, sf):
    c = K.canon(spark, sf)
    return P.rank_products(c.get("lines"), K.products(c.t), 10, ascending=True)


@register("by_category", """
    SELECT category, sum(line_total)::DOUBLE AS revenue, count(DISTINCT order_id) AS orders
    FROM lines_prod_c WHERE sku_quality = 'ok' AND category IS NOT NULL GROUP BY 1""", "lines_prod_c")
def by_category(spark, sf):
    return P.by_category(K.lines_with_product(K.canon(spark, sf).t))


@register("by_category_realized", """
    SELECT category, sum(line_total)::DOUBLE AS revenue, count(DISTINCT order_id) AS orders
    FROM lines_prod_c SEMI JOIN realized_c USING (order_id) WHERE sku_quality = 'ok' AND category IS NOT NULL GROUP BY 1""",
          "lines_prod_c", "realized_c")
def by_category_realized(spark, sf):
    """D8: product KPIs over the lines of realized orders only."""
    c = K.canon(spark, sf)
    v = K.realized(c.get("orders")).select("order_id")
    return P.by_category(K.lines_with_product(c.t, c.get("lines").join(v, "order_id", "left_semi")))


@register("by_subcategory", """
    WITH cat AS (SELECT DISTINCT TRY_CAST("SkU" AS BIGINT) AS sku, categorie AS category,
                        coalesce(trim(string_split("Sous-catégorie", '>')[2]), 'Unknown') AS subcategory
                 FROM raw_catalogue_c WHERE "SkU" IS NOT NULL)
    SELECT c.subcategory, sum(l.line_total)::DOUBLE AS revenue, count(DISTINCT l.order_id) AS orders
    FROM lines_c l LEFT JOIN cat c USING (sku)
    WHERE l.sku_quality = 'ok' AND c.subcategory IS NOT NULL GROUP BY 1""", "lines_c", "raw_catalogue_c")
def by_subcategory(spark, sf):
    c = K.canon(spark, sf)
    return P.by_subcategory(c.get("lines"), catalogue_dims(c))


@register("product_quantity", """
    SELECT product_name, sum(quantity) AS total_units_sold,
           sum(quantity) / count(quantity) AS avg_quantity_per_order,
           count(DISTINCT order_id) AS number_of_orders
    FROM lines_prod_c WHERE sku_quality = 'ok' AND product_name IS NOT NULL GROUP BY 1""", "lines_prod_c")
def product_quantity(spark, sf):
    return P.product_quantity(K.lines_with_product(K.canon(spark, sf).t))


@register("price_volume", """
    SELECT product_name, sum(quantity) AS total_units_sold,
           sum(unit_price)::DOUBLE / count(unit_price)::DOUBLE AS avg_price,
           sum(line_total)::DOUBLE AS revenue
    FROM lines_prod_c WHERE sku_quality = 'ok' AND product_name IS NOT NULL GROUP BY 1""", "lines_prod_c")
def price_volume(spark, sf):
    c = K.canon(spark, sf)
    return P.price_volume(c.get("lines"), K.products(c.t))


@register("price_volume_corr", """
    WITH pv AS (SELECT product_name, sum(quantity) AS total_units_sold,
                       sum(unit_price)::DOUBLE / count(unit_price)::DOUBLE AS avg_price
                FROM lines_prod_c WHERE sku_quality = 'ok' AND product_name IS NOT NULL GROUP BY 1)
    SELECT round(corr(avg_price, total_units_sold), 9) AS price_units_corr, count(*) AS products FROM pv""",
          "lines_prod_c")
def price_volume_corr(spark, sf):
    c = K.canon(spark, sf)
    return P.price_volume_corr(c.get("lines"), K.products(c.t))


@register("median_price_recovery", """
    WITH cat AS (SELECT DISTINCT TRY_CAST("SkU" AS BIGINT) AS sku,
                        TRY_CAST("Prix unitaire" AS DECIMAL(12,2)) AS unit_price FROM raw_catalogue_c),
         miss AS (SELECT DISTINCT sku FROM cat WHERE unit_price IS NULL AND sku IS NOT NULL)
    SELECT sku, median(unit_price::DOUBLE) AS recovered_unit_price
    FROM lines_c WHERE sku IN (SELECT sku FROM miss) GROUP BY 1""", "lines_c", "raw_catalogue_c")
def median_price_recovery(spark, sf):
    c = K.canon(spark, sf)
    return CL.recovered_prices(catalogue_typed(c), c.get("lines"))


@register("ever_sold", f"""
    WITH cat AS (SELECT DISTINCT * FROM raw_catalogue_c)
    SELECT TRY_CAST("SkU" AS BIGINT) AS sku, {norm_sql('"Nom"')} AS product_name,
           coalesce(TRY_CAST("SkU" AS BIGINT) IN (SELECT DISTINCT sku FROM lines_c), false) AS ever_sold
    FROM cat""", "lines_c", "raw_catalogue_c")
def ever_sold(spark, sf):
    c = K.canon(spark, sf)
    return CL.with_ever_sold(catalogue_typed(c), c.get("lines")).select("sku", "product_name", "ever_sold")


@register("return_rate", """
    SELECT product_name, count_if(returned) AS returned_lines, count(*) AS lines,
           count_if(returned)::DOUBLE / count(*)::DOUBLE AS return_rate
    FROM lines_prod_c WHERE sku_quality = 'ok' AND product_name IS NOT NULL GROUP BY 1""", "lines_prod_c")
def return_rate(spark, sf):
    c = K.canon(spark, sf)
    return P.return_rate(c.get("lines"), K.products(c.t))


@register("clean_catalogue", f"""
    WITH cat AS (SELECT DISTINCT "SkU", "Nom", categorie, "Sous-catégorie",
                        TRY_CAST("Prix unitaire" AS DECIMAL(12,2)) AS unit_price, stock_status, short_desc
                 FROM raw_catalogue_c),
         typed AS (SELECT TRY_CAST("SkU" AS BIGINT) AS sku, {norm_sql('"Nom"')} AS product_name,
                          categorie AS category, "Sous-catégorie" AS subcategory, unit_price,
                          stock_status, short_desc FROM cat),
         miss AS (SELECT DISTINCT sku FROM typed WHERE unit_price IS NULL AND sku IS NOT NULL),
         rec AS (SELECT sku, median(unit_price::DOUBLE) AS rp FROM lines_c
                 WHERE sku IN (SELECT sku FROM miss) GROUP BY 1),
         sold AS (SELECT DISTINCT sku FROM lines_c)
    SELECT t.sku, t.product_name, t.category,
           coalesce(trim(string_split(t.subcategory, '>')[2]), 'Unknown') AS subcategory,
           coalesce(t.unit_price::DOUBLE, rec.rp) AS unit_price, t.stock_status, t.short_desc,
           coalesce(t.sku IN (SELECT sku FROM sold), false) AS ever_sold
    FROM typed t LEFT JOIN rec USING (sku)""", "lines_c", "raw_catalogue_c")
def clean_catalogue(spark, sf):
    c = K.canon(spark, sf)
    return CL.clean_catalogue(c.get("raw_catalogue"), c.get("lines")).select(
        "sku", "product_name", "category", "subcategory", "unit_price", "stock_status", "short_desc", "ever_sold")


def _cross_sql(item: str, share: str) -> str:
    return f"""
    WITH b AS (SELECT DISTINCT order_id, {item} AS item FROM lines_prod_c WHERE sku_quality = 'ok' AND order_id IS NOT NULL AND {item} IS NOT NULL),
    n AS (SELECT count(DISTINCT order_id) AS n FROM b),
    s AS (SELECT n, greatest(2, ceil({share} * n - 1e-9)) AS least FROM n),
    i AS (SELECT item, count(*) AS c FROM b GROUP BY 1 HAVING count(*) >= (SELECT least FROM s)),
    f AS (SELECT b.* FROM b SEMI JOIN i USING (item)),
    p AS (SELECT x.item AS a, y.item AS b, count(*) AS t FROM f x JOIN f y ON x.order_id = y.order_id AND x.item < y.item
          GROUP BY 1, 2 HAVING count(*) >= (SELECT least FROM s)),
    m AS (SELECT p.*, ia.c::DOUBLE AS ca, ib.c::DOUBLE AS cb, n::DOUBLE AS n, t::DOUBLE AS td
          FROM p JOIN i ia ON ia.item = p.a JOIN i ib ON ib.item = p.b, s)
    SELECT a AS product_a, b AS product_b, t AS orders, round(td / n * 1e9) / 1e9 AS support, round(td / ca * 1e6) / 1e6 AS confidence_ab,
           round(td / cb * 1e6) / 1e6 AS confidence_ba, round(td * n / (ca * cb) * 1e6) / 1e6 AS lift FROM m"""


def _baskets(c: K.Canon, item: str):
    return P.reliable(K.lines_with_product(c.t)).select(F.col("order_id").alias("basket"), F.col(item).alias("item"))


#: Least shares of orders that hold both, for products and for categories.
CROSS_SHARE, CROSS_CATEGORY_SHARE = "0.0001", "0.001"


@register("cross_selling", _cross_sql("product_name", CROSS_SHARE), "lines_prod_c")
def cross_selling(spark, sf):
    """Declared cross-selling: products in at least one of 10,000 orders together (and in two), with support, confidence and lift."""
    return XS.cross_selling(_baskets(K.canon(spark, sf), "product_name"), min_share=float(CROSS_SHARE))


@register("cross_selling_categories", _cross_sql("category", CROSS_CATEGORY_SHARE), "lines_prod_c")
def cross_selling_categories(spark, sf):
    """The same for categories in at least one of 1,000 orders together."""
    return XS.cross_selling(_baskets(K.canon(spark, sf), "category"), min_share=float(CROSS_CATEGORY_SHARE))
