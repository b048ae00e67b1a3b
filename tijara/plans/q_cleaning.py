"""Registered cleaning queries on the raw text exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import cleaning as CL
from ..session import disk_spared, write_shared
from . import canonical as K
from .oracle import CTES, free_shipping_sql, payment_label_sql, shipping_class_sql
from .q_products import norm_sql
from .registry import register


def _money_sql(c: str) -> str:
    return f"TRY_CAST(replace(replace({c}, ' DA', ''), ',', '') AS DECIMAL(12,2))"


CTES["typed_tx_c"] = (["raw_transactions_c"], f"""
    SELECT DISTINCT order_id_stage, "Code Client" AS customer_id_stage,
           try_strptime(order_date, '%Y-%m-%d %H:%M:%S') AS order_date, wilaya_raw, customer_type_inferred,
           TRY_CAST(sku AS BIGINT) AS sku, product_name, category, subcategory, sku_quality,
           TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(unit_price AS DECIMAL(12,2)) AS unit_price,
           TRY_CAST(line_total AS DECIMAL(12,2)) AS line_total, order_status,
           "Titre moyen du paiement" AS payment_method, "Titre de la méthode d’expédition" AS shipping_method,
           {_money_sql('"Montant total de la commande"')} AS order_total_amount,
           {_money_sql('"Montant de l’expédition commande"')} AS shipping_cost,
           "Poids total" AS total_weight
    FROM raw_transactions_c""")

CTES["clean_tx_c"] = (["typed_tx_c", "raw_catalogue_c"], f"""
    WITH named AS (SELECT * REPLACE ({norm_sql('product_name')} AS product_name) FROM typed_tx_c
                   WHERE quantity IS NOT NULL AND unit_price IS NOT NULL AND line_total IS NOT NULL),
    cat AS (SELECT sku, pn_cat, sc_cat FROM (
              SELECT TRY_CAST("SkU" AS BIGINT) AS sku, {norm_sql('"Nom"')} AS pn_cat, "Sous-catégorie" AS sc_cat,
                     row_number() OVER (PARTITION BY TRY_CAST("SkU" AS BIGINT)
                                        ORDER BY {norm_sql('"Nom"')} NULLS FIRST, "Sous-catégorie" NULLS FIRST) AS rn
              FROM raw_catalogue_c WHERE TRY_CAST("SkU" AS BIGINT) IS NOT NULL) WHERE rn = 1),
    enriched AS (SELECT n.* REPLACE (coalesce(n.product_name, c.pn_cat, 'Unknown') AS product_name,
                                     coalesce(n.subcategory, c.sc_cat, 'Unknown') AS subcategory),
                        coalesce(n.unit_price < 0, false) AS has_negative_price
                 FROM named n LEFT JOIN cat c USING (sku))
    SELECT * REPLACE ({shipping_class_sql('shipping_method')} AS shipping_method,
                      {payment_label_sql('payment_method')} AS payment_method),
           {free_shipping_sql('shipping_method')} AS free_shipping
    FROM enriched""")


def clean_tx(c: K.Canon):
    key = "clean_tx"
    if key not in c._cache:
        stored = "typed_tx" in c._cache
        c._cache[key] = CL.finish_transactions(typed_tx(c), c.get("raw_catalogue"), stored)
    return c._cache[key]


def typed_tx(c: K.Canon):
    if "typed_tx" in c._cache:
        return c._cache["typed_tx"]
    return CL.dedupe_rows(CL.typed_transactions(c.get("raw_transactions")))


def store_typed(c: K.Canon) -> None:
    """For a query that reads whole clean rows, or reads them more than once: the
    typed, deduplicated rows are written, and what follows starts from them."""
    if "typed_tx" not in c._cache:
        df = CL.dedupe_in_place(CL.typed_transactions(c.get("raw_transactions")))
        with disk_spared(df.sparkSession):
            c._cache["typed_tx"] = write_shared(df, "typed-transactions")


@register("money_parse", f"""
    SELECT payment_method_group, count(*) AS rows,
           count({_money_sql('"Montant total de la commande"')}) AS parsed,
           sum({_money_sql('"Montant total de la commande"')})::DOUBLE AS order_amount,
           sum({_money_sql('"Montant de l’expédition commande"')})::DOUBLE AS shipping_cost
    FROM raw_transactions_c GROUP BY 1""", "raw_transactions_c")
def money_parse(spark, sf):
    raw = K.canon(spark, sf).get("raw_transactions")
    amt = C.parse_money("Montant total de la commande")
    ship = C.parse_money("Montant de l’expédition commande")
    return raw.groupBy("payment_method_group").agg(
        F.count("*").alias("rows"), F.count(amt).alias("parsed"),
        F.sum(amt).cast("double").alias("order_amount"), F.sum(ship).cast("double").alias("shipping_cost"))


@register("date_coerce", """
    SELECT count(*) AS rows, count_if(try_strptime(order_date, '%Y-%m-%d %H:%M:%S') IS NULL) AS bad_dates,
           min(try_strptime(order_date, '%Y-%m-%d %H:%M:%S')) AS min_date,
           max(try_strptime(order_date, '%Y-%m-%d %H:%M:%S')) AS max_date
    FROM raw_transactions_c""", "raw_transactions_c")
def date_coerce(spark, sf):
    d = C.parse_timestamp("order_date")
    return K.canon(spark, sf).get("raw_transactions").agg(
        F.count("*").alias("rows"), F.count_if(d.isNull()).alias("bad_dates"),
        F.min(d).alias("min_date"), F.max(d).alias("max_date"))


@register("name_clean", f"""
    SELECT {norm_sql('product_name')} AS product_name, count(*) AS rows, count(DISTINCT product_name) AS raw_variants
    FROM raw_transactions_c GROUP BY 1""", "raw_transactions_c")
def name_clean(spark, sf):
    raw = K.canon(spark, sf).get("raw_transactions")
    return raw.groupBy(C.normalize_space("product_name").alias("product_name")).agg(
        F.count("*").alias("rows"), F.countDistinct("product_name").alias("raw_variants"))


@register("payment_labels", f"""
    SELECT "Titre moyen du paiement" AS raw_label, {payment_label_sql('"Titre moyen du paiement"')} AS payment_method,
           count(*) AS rows
    FROM raw_transactions_c GROUP BY 1, 2""", "raw_transactions_c")
def payment_labels(spark, sf):
    raw = K.canon(spark, sf).get("raw_transactions")
    lab = F.col("Titre moyen du paiement")
    return raw.groupBy(lab.alias("raw_label"), C.payment_label(lab).alias("payment_method")).agg(
        F.count("*").alias("rows"))


_SHIP = '"Titre de la méthode d’expédition"'


@register("free_shipping_flag", f"""
    SELECT {_SHIP} AS raw_label, {free_shipping_sql(_SHIP)} AS free_shipping, count(*) AS rows
    FROM raw_transactions_c GROUP BY 1, 2""", "raw_transactions_c")
def free_shipping_flag(spark, sf):
    lab = F.col("Titre de la méthode d’expédition")
    return K.canon(spark, sf).get("raw_transactions").groupBy(
        lab.alias("raw_label"), C.free_shipping(lab).alias("free_shipping")).agg(F.count("*").alias("rows"))


@register("shipping_classes", f"""
    SELECT {_SHIP} AS raw_label, {shipping_class_sql(_SHIP)} AS shipping_method, count(*) AS rows
    FROM raw_transactions_c GROUP BY 1, 2""", "raw_transactions_c")
def shipping_classes(spark, sf):
    lab = F.col("Titre de la méthode d’expédition")
    return K.canon(spark, sf).get("raw_transactions").groupBy(
        lab.alias("raw_label"), C.shipping_class(lab).alias("shipping_method")).agg(F.count("*").alias("rows"))


@register("subcategory_split", """
    SELECT "Sous-catégorie" AS raw_path,
           coalesce(trim(string_split("Sous-catégorie", '>')[2]), 'Unknown') AS split_then_fill,
           trim(string_split(coalesce("Sous-catégorie", 'unknown'), '>')[2]) AS fill_then_split,
           count(*) AS rows
    FROM raw_catalogue_c GROUP BY 1, 2, 3""", "raw_catalogue_c")
def subcategory_split(spark, sf):
    """O-3.15 and defect D3 side by side: our order (split, then fill) and the
    source order (fill, then split, which nulls the fill)."""
    raw = K.canon(spark, sf).get("raw_catalogue")
    p = F.col("Sous-catégorie")
    return raw.groupBy(p.alias("raw_path"),
                       F.coalesce(C.path_part(p, 1), F.lit("Unknown")).alias("split_then_fill"),
                       C.path_part(F.coalesce(p, F.lit("unknown")), 1).alias("fill_then_split")
                       ).agg(F.count("*").alias("rows"))


@register("id_repair", f"""
    SELECT count(*) AS rows,
           count_if(customer_id_stage <> regexp_replace(customer_id_stage, 'CLT_S(\\d{{5}})$', 'CLT_S0\\1')) AS repaired,
           count(DISTINCT customer_id_stage) AS distinct_raw,
           count(DISTINCT regexp_replace(customer_id_stage, 'CLT_S(\\d{{5}})$', 'CLT_S0\\1')) AS distinct_repaired
    FROM raw_orders_c""", "raw_orders_c")
def id_repair(spark, sf):
    raw = K.canon(spark, sf).get("raw_orders")
    fixed = C.repair_customer_id("customer_id_stage")
    return raw.agg(F.count("*").alias("rows"), F.count_if(F.col("customer_id_stage") != fixed).alias("repaired"),
                   F.countDistinct("customer_id_stage").alias("distinct_raw"),
                   F.countDistinct(fixed).alias("distinct_repaired"))


@register("drop_incomplete", """
    SELECT count(*) AS rows_before,
           count_if(quantity IS NOT NULL AND unit_price IS NOT NULL AND line_total IS NOT NULL) AS rows_after,
           count_if(quantity IS NULL OR unit_price IS NULL OR line_total IS NULL) AS removed
    FROM typed_tx_c""", "typed_tx_c")
def drop_incomplete(spark, sf):
    t = typed_tx(K.canon(spark, sf))
    kept = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull() & F.col("line_total").isNotNull()
    return t.agg(F.count("*").alias("rows_before"), F.count_if(kept).alias("rows_after"),
                 F.count_if(~kept).alias("removed"))


@register("dedupe_rows", """
    SELECT (SELECT count(*) FROM raw_transactions_c) AS rows_before,
           (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_transactions_c)) AS rows_after,
           (SELECT count(*) FROM raw_transactions_c) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_transactions_c))
             AS removed""", "raw_transactions_c")
def dedupe_rows(spark, sf):
    raw = K.canon(spark, sf).get("raw_transactions")
    g = raw.groupBy(*C.row_key(raw)).count()
    return g.agg(F.sum("count").alias("rows_before"), F.count("*").alias("rows_after"),
                 (F.sum("count") - F.count("*")).alias("removed"))


@register("dedupe_keys", """
    SELECT order_id_stage, customer_id_stage, order_date, order_status, payment_method_group,
           order_total_amount, ingest_pos
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id_stage ORDER BY ingest_pos) AS rn FROM raw_orders_c)
    WHERE rn = 1""", "raw_orders_c")
def dedupe_keys(spark, sf):
    raw = K.canon(spark, sf).get("raw_orders")
    return CL.dedupe_keys(raw, ["order_id_stage"], ["ingest_pos"])


@register("dup_key_report", """
    SELECT * FROM raw_orders_c
    WHERE order_id_stage IN (SELECT order_id_stage FROM raw_orders_c GROUP BY 1 HAVING count(*) > 1)""",
          "raw_orders_c")
def dup_key_report(spark, sf):
    return CL.duplicate_key_rows(K.canon(spark, sf).get("raw_orders"), ["order_id_stage"])


@register("clean_transactions_summary", """
    SELECT subcategory, shipping_method, payment_method, count(*) AS rows,
           sum(line_total)::DOUBLE AS revenue, count_if(has_negative_price) AS negative_price_rows,
           count_if(free_shipping) AS free_shipping_rows, count_if(product_name = 'Unknown') AS unknown_names
    FROM clean_tx_c GROUP BY 1, 2, 3""", "clean_tx_c")
def clean_transactions_summary(spark, sf):
    t = clean_tx(K.canon(spark, sf))
    return t.groupBy("subcategory", "shipping_method", "payment_method").agg(
        F.count("*").alias("rows"), F.sum("line_total").cast("double").alias("revenue"),
        F.count_if("has_negative_price").alias("negative_price_rows"),
        F.count_if("free_shipping").alias("free_shipping_rows"),
        F.count_if(F.col("product_name") == "Unknown").alias("unknown_names"))


def _ref_sql(expr: str) -> str:
    return f"""
    WITH a AS (SELECT DISTINCT {expr} AS k FROM raw_orders_c WHERE customer_id_stage IS NOT NULL),
         b AS (SELECT DISTINCT customer_code AS k FROM customers_c WHERE customer_code IS NOT NULL)
    SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys,
           (SELECT count(*) FROM a JOIN b USING (k)) AS matched,
           (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS left_only,
           (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS right_only"""


@register("referential_check_raw", _ref_sql("customer_id_stage"), "raw_orders_c", "customers_c")
def referential_check_raw(spark, sf):
    c = K.canon(spark, sf)
    return CL.key_overlap(c.get("raw_orders"), c.get("customers"), "customer_id_stage", "customer_code")


@register("referential_check_repaired",
          _ref_sql("regexp_replace(customer_id_stage, 'CLT_S(\\d{5})$', 'CLT_S0\\1')"), "raw_orders_c", "customers_c")
def referential_check_repaired(spark, sf):
    c = K.canon(spark, sf)
    return CL.key_overlap(CL.repair_ids(c.get("raw_orders")), c.get("customers"), "customer_id_stage",
                          "customer_code")


@register("distinct_shipping_methods", "SELECT DISTINCT shipping_method FROM clean_tx_c", "clean_tx_c")
def distinct_shipping_methods(spark, sf):
    """O-1.12 / O-10.1: distinct delivery classes (the export writes this frame)."""
    return clean_tx(K.canon(spark, sf)).select("shipping_method").distinct()


@register("enrich_lines", """
    SELECT count(*) AS rows, count_if(product_name = 'Unknown') AS unknown_product,
           count_if(subcategory = 'Unknown') AS unknown_subcategory,
           count_if(has_negative_price) AS has_negative_price
    FROM clean_tx_c""", "clean_tx_c")
def enrich_lines(spark, sf):
    t = clean_tx(K.canon(spark, sf))
    return t.agg(F.count("*").alias("rows"), F.count_if(F.col("product_name") == "Unknown").alias("unknown_product"),
                 F.count_if(F.col("subcategory") == "Unknown").alias("unknown_subcategory"),
                 F.count_if("has_negative_price").alias("has_negative_price"))

