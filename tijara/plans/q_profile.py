"""Registered profiling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from ..operators import profile as PR
from ..operators import sketches as SK
from ..session import shared_path
from . import canonical as K
from .oracle import CTES
from .q_cleaning import clean_tx, store_typed, typed_tx
from .registry import register

# Column lists of the raw transactions export, for the SQL side.
RAW_TX_COLS = ["order_id_stage", "Code Client", "order_date", "wilaya_raw", "customer_type_inferred", "sku",
               "product_name", "category", "subcategory", "sku_quality", "quantity", "unit_price", "line_total",
               "order_status", "payment_method_group", "Titre moyen du paiement",
               "Titre de la méthode d’expédition", "Montant total de la commande",
               "Montant de l’expédition commande", "Poids total"]


def qi(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def _long_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c.replace(chr(39), chr(39) * 2)}' AS \"column\", CAST({qi(c)} AS VARCHAR) AS value FROM {table}"
        for c in cols)


CTES["raw_tx_long_c"] = (["raw_transactions_c"], _long_sql("raw_transactions_c", RAW_TX_COLS))


@register("null_counts", """
    SELECT "column", count_if(value IS NULL) AS nulls FROM raw_tx_long_c GROUP BY 1""", "raw_tx_long_c")
def null_counts(spark, sf):
    return PR.null_counts(K.canon(spark, sf).get("raw_transactions"))


@register("dup_rows", """
    SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_rows
    FROM (SELECT count(*) AS n FROM raw_transactions_c GROUP BY """ + ", ".join(qi(c) for c in RAW_TX_COLS) + """)""",
          "raw_transactions_c")
def dup_rows(spark, sf):
    return PR.duplicate_rows(K.canon(spark, sf).get("raw_transactions"))


@register("dup_occurrences", f"""
    SELECT {', '.join(qi(c) for c in RAW_TX_COLS)}, occurrence FROM (
      SELECT *, row_number() OVER (PARTITION BY {', '.join(qi(c) for c in RAW_TX_COLS)}) AS occurrence
      FROM raw_transactions_c) WHERE occurrence > 1""", "raw_transactions_c")
def dup_occurrences(spark, sf):
    return PR.duplicate_occurrences(K.canon(spark, sf).get("raw_transactions"), [])


@register("null_key_rows", """
    SELECT * FROM raw_catalogue_c WHERE "SkU" IS NULL""", "raw_catalogue_c")
def null_key_rows(spark, sf):
    """O-2.6: catalogue rows with no key."""
    return K.canon(spark, sf).get("raw_catalogue").filter(F.col("SkU").isNull())


@register("distinct_counts", """
    SELECT "column", count(DISTINCT value) AS distinct_values FROM raw_tx_long_c GROUP BY 1""", "raw_tx_long_c")
def distinct_counts(spark, sf):
    return PR.distinct_counts(K.canon(spark, sf).get("raw_transactions"))


NUM_COLS = ["quantity", "unit_price", "line_total", "order_total_amount"]
TEXT_COLS = ["shipping_method", "payment_method", "subcategory", "sku_quality"]


@register("describe_numeric", "SELECT \"column\", count(value) AS count, round(avg(value), 6) AS mean, "
          "round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM clean_tx_c" for c in NUM_COLS)
          + ") GROUP BY 1", "clean_tx_c")
def describe_numeric(spark, sf):
    return PR.describe_numeric(clean_tx(K.canon(spark, sf)), NUM_COLS)


@register("describe_quartiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + " FROM clean_tx_c" for c in NUM_COLS), "clean_tx_c")
def describe_quartiles(spark, sf):
    """Quartiles of O-2.7: exact, linear between neighbours."""
    return PR.describe_quartiles(clean_tx(K.canon(spark, sf)), NUM_COLS)


@register("describe_text", """
    WITH vc AS (SELECT "column", value, count(*) AS n FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM clean_tx_c" for c in TEXT_COLS) + """)
                WHERE value IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM vc)
    SELECT "column", sum(n)::BIGINT AS count, count(*) AS "unique",
           max(CASE WHEN rn = 1 THEN value END) AS top, max(CASE WHEN rn = 1 THEN n END) AS freq
    FROM r GROUP BY 1""", "clean_tx_c")
def describe_text(spark, sf):
    return PR.describe_text(clean_tx(K.canon(spark, sf)), TEXT_COLS)


@register("rule_counts", """
    SELECT * FROM (SELECT count_if(quantity < 0) AS negative_quantity, count_if(unit_price < 0) AS negative_unit_price,
                          count_if(line_total < 0) AS negative_line_total,
                          count_if(order_date > (SELECT max(order_date) FROM orders_c)) AS future_order_date
                   FROM clean_tx_c)
    UNPIVOT (violations FOR rule IN (negative_quantity, negative_unit_price, negative_line_total, future_order_date))""",
          "clean_tx_c", "orders_c")
def rule_counts(spark, sf):
    """Violations as of the latest order in the facts (not the clock)."""
    c = K.canon(spark, sf)
    return PR.rule_counts(clean_tx(c), c.get("orders").agg(F.max("order_date")).scalar())


@register("value_counts", """
    SELECT shipping_method AS value, count(*) AS count FROM clean_tx_c GROUP BY 1""", "clean_tx_c")
def value_counts(spark, sf):
    return PR.value_counts(clean_tx(K.canon(spark, sf)), "shipping_method")


@register("value_counts_raw_payment", """
    SELECT "Titre moyen du paiement" AS value, count(*) AS count FROM raw_transactions_c GROUP BY 1""",
          "raw_transactions_c")
def value_counts_raw_payment(spark, sf):
    return PR.value_counts(K.canon(spark, sf).get("raw_transactions"), "Titre moyen du paiement")


@register("column_profile", """
    SELECT "column" AS name,
           CASE WHEN count(value) > 0 AND count(TRY_CAST(value AS DOUBLE)) = count(value) THEN 'number'
                WHEN count(value) > 0 AND count(try_strptime(value, '%Y-%m-%d %H:%M:%S')) = count(value) THEN 'datetime'
                ELSE 'string' END AS inferred_type,
           count(value) AS non_null_count, count_if(value IS NULL) AS missing_count,
           count(DISTINCT value) AS unique_count
    FROM raw_tx_long_c GROUP BY 1""", "raw_tx_long_c")
def column_profile(spark, sf):
    return PR.column_profile(K.canon(spark, sf).get("raw_transactions"))


CLEANING_SUMMARY_SQL = """
    WITH s AS (
      SELECT 'transactions' AS dataset, (SELECT count(*) FROM raw_transactions_c) AS rows_raw,
             (SELECT count(*) FROM clean_tx_c) AS rows_clean
      UNION ALL
      SELECT 'catalogue', (SELECT count(*) FROM raw_catalogue_c),
             (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_catalogue_c))
      UNION ALL
      SELECT 'orders', (SELECT count(*) FROM raw_orders_c), (SELECT count(DISTINCT order_id_stage) FROM raw_orders_c))
    SELECT dataset, rows_raw, rows_clean, rows_raw - rows_clean AS rows_removed,
           round((rows_raw - rows_clean)::DOUBLE / nullif(rows_raw, 0)::DOUBLE * 100.0, 2) AS pct_removed
    FROM s"""


def cleaning_summary_df(spark, sf):
    from ..operators import cleaning as CLN
    c = K.canon(spark, sf)
    parts = [
        ("transactions", c.get("raw_transactions"), clean_tx(c)),
        ("catalogue", c.get("raw_catalogue"), CLN.dedupe_rows(c.get("raw_catalogue"))),
        ("orders", c.get("raw_orders"), CLN.dedupe_keys(c.get("raw_orders"), ["order_id_stage"], ["ingest_pos"])),
    ]
    out = None
    for name, raw, clean in parts:
        row = raw.agg(F.count("*").alias("rows_raw")).select(
            F.lit(name).alias("dataset"), "rows_raw", clean.agg(F.count("*")).scalar().alias("rows_clean"))
        out = row if out is None else out.unionByName(row)
    removed = F.col("rows_raw") - F.col("rows_clean")
    return out.select("dataset", "rows_raw", "rows_clean", removed.alias("rows_removed"),
                      round_dp(F.try_divide(removed.cast("double"), F.col("rows_raw").cast("double")) * 100.0, 2)
                      .alias("pct_removed"))


@register("cleaning_summary", CLEANING_SUMMARY_SQL, "raw_transactions_c", "clean_tx_c", "raw_catalogue_c",
          "raw_orders_c")
def cleaning_summary(spark, sf):
    """O-2.11 + O-10.5: before/after rows per dataset, stacked."""
    return cleaning_summary_df(spark, sf)


@register("date_coverage", """
    WITH r AS (
      SELECT 'transactions' AS dataset, 1 AS prio, min(order_date) AS date_min, max(order_date) AS date_max
      FROM clean_tx_c
      UNION ALL
      SELECT 'orders', 2, min(order_date), max(order_date) FROM orders_c)
    SELECT dataset, date_min, date_max FROM r WHERE date_min IS NOT NULL AND date_max IS NOT NULL
    ORDER BY prio LIMIT 1""", "clean_tx_c", "orders_c")
def date_coverage(spark, sf):
    """O-2.14: date range of the first dataset (transactions, then orders) that has one."""
    return date_coverage_of(K.canon(spark, sf))


def date_coverage_of(c: K.Canon):
    t = clean_tx(c).agg(F.lit("transactions").alias("dataset"), F.lit(1).alias("prio"),
                        F.min("order_date").alias("date_min"), F.max("order_date").alias("date_max"))
    o = c.get("orders").agg(F.lit("orders").alias("dataset"), F.lit(2).alias("prio"),
                            F.min("order_date").alias("date_min"), F.max("order_date").alias("date_max"))
    both = t.unionByName(o).filter(F.col("date_min").isNotNull() & F.col("date_max").isNotNull())
    return both.orderBy("prio").limit(1).drop("prio")


CLEAN_TX_COLS = ["sku", "order_id_stage", "customer_id_stage", "order_date", "wilaya_raw", "customer_type_inferred", "product_name",
                 "category", "subcategory", "sku_quality", "quantity", "unit_price", "line_total", "order_status", "payment_method",
                 "shipping_method", "order_total_amount", "shipping_cost", "total_weight", "has_negative_price", "free_shipping"]


@register("prep_metrics", """
    WITH raw AS (SELECT count(*) AS received,
                        sum(""" + " + ".join(
    f"CASE WHEN {qi(c)} IS NULL OR trim(CAST({qi(c)} AS VARCHAR)) = '' THEN 1 ELSE 0 END" for c in RAW_TX_COLS) + """)
                        ::BIGINT AS raw_missing FROM raw_transactions_c),
         dup AS (SELECT sum(n - 1)::BIGINT AS raw_duplicates FROM (SELECT count(*) AS n FROM raw_transactions_c GROUP BY """ + ", ".join(qi(c) for c in RAW_TX_COLS) + """)),
         cl AS (SELECT count(*) AS retained, sum(""" + " + ".join(
    f"CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END" for c in CLEAN_TX_COLS) + """)::BIGINT AS cleaned_missing
                FROM clean_tx_c),
         cd AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS cleaned_duplicates FROM (SELECT count(*) AS n FROM clean_tx_c GROUP BY """ + ", ".join(CLEAN_TX_COLS) + """) z),
         rej AS (SELECT count_if(quantity IS NULL OR unit_price IS NULL OR line_total IS NULL) AS rejected
                 FROM typed_tx_c)
    SELECT received, retained, greatest(0, received - retained) AS removed, raw_missing, raw_duplicates, cleaned_missing,
           cleaned_duplicates, rejected,
           round(retained::DOUBLE / nullif(received, 0)::DOUBLE * 100.0, 1) AS retention_pct,
           round(greatest(0, received - retained)::DOUBLE / nullif(received, 0)::DOUBLE * 100.0, 1) AS removed_pct
    FROM raw, dup, cl, cd, rej""", "raw_transactions_c", "clean_tx_c", "typed_tx_c")
def prep_metrics(spark, sf):
    """O-2.15: received / retained / removed, missing cells, duplicates and
    rejected rows of a preparation run; percentages to one decimal."""
    return prep_metrics_of(K.canon(spark, sf))


def prep_metrics_of(c: K.Canon):
    raw = c.get("raw_transactions")
    store_typed(c)
    t = typed_tx(c)
    # one pass over the raw and one over the clean table; counts join as scalar subqueries
    cl = PR.table_quality(clean_tx(c)).select(F.struct("rows", "missing", "duplicate_rows")).scalar()
    j = PR.table_quality(raw).select(
        F.col("rows").alias("received"), F.col("missing").alias("raw_missing"), F.col("duplicate_rows").alias("raw_duplicates"),
        cl["rows"].alias("retained"), cl["missing"].alias("cleaned_missing"), cl["duplicate_rows"].alias("cleaned_duplicates"),
        t.agg(F.count_if(F.col("quantity").isNull() | F.col("unit_price").isNull()
                         | F.col("line_total").isNull())).scalar().alias("rejected"))
    removed = F.greatest(F.lit(0), F.col("received") - F.col("retained"))
    return j.select("received", "retained", removed.alias("removed"), "raw_missing", "raw_duplicates", "cleaned_missing",
                    F.coalesce("cleaned_duplicates", F.lit(0)).alias("cleaned_duplicates"), "rejected",
                    PR.percentage(F.col("retained"), F.col("received")).alias("retention_pct"),
                    PR.percentage(removed, F.col("received")).alias("removed_pct"))


@register("incremental_profile", """
    SELECT "column", count(*)::BIGINT AS rows, count_if(value IS NULL)::BIGINT AS missing, true AS distinct_within_error,
           min(x) AS low, max(x) AS high, count(x)::BIGINT AS n_numbers
    FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM raw_tx_long_c) GROUP BY 1""", "raw_tx_long_c")
def incremental_profile(spark, sf):
    """O-2.13 by sketches: the raw transactions profiled load by load (their order year) and merged on read; the estimate of
    distinct values is held against the exact number."""
    raw = K.canon(spark, sf).get("raw_transactions")
    path = shared_path(spark, "profiles", uuid.uuid4().hex[:12])
    SK.append(raw, path, F.substring("order_date", 1, 4))
    m = SK.merged(SK.read(spark, path))
    exact = PR.distinct_counts(raw).withColumnRenamed("column", "_c").withColumnRenamed("distinct_values", "_exact")
    off = F.abs(F.col("distinct_values") - F.col("_exact"))
    return m.join(exact, F.col("column") == F.col("_c")).select(
        "column", "rows", "missing", (off <= F.col("_exact") * SK.DISTINCT_ERROR + 0.5).alias("distinct_within_error"), "low", "high", "n_numbers")
