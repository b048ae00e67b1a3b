"""Registered file-landing queries: landing CSVs written by Spark from the
raw exports, then scanned, detected and profiled (SURVEY §7.4 step 13)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import traffic as TR
from ..sources import files as FS
from . import canonical as K
from .q_profile import qi
from .registry import register

EXPORTS = {"transactions": ("raw_transactions", ";"), "catalogue": ("raw_catalogue", ","),
           "orders": ("raw_orders", ",")}


def _landing(spark, sf, names=tuple(EXPORTS)):
    """Folder with the landing files of the named exports; others are not written."""
    c = K.canon(spark, sf)
    frames = {name: (lambda src=EXPORTS[name][0]: c.get(src), EXPORTS[name][1]) for name in names}
    return FS.ensure_landing(spark, sf, frames)


def _dataset_folders(spark, sf):
    root = _landing(spark, sf)
    return [os.path.join(root, name) for name in EXPORTS]


def _cols(spark, sf, src):
    return K.canon(spark, sf).get(src).columns


def _quality_sql() -> str:
    from .q_profile import RAW_TX_COLS
    cat = ["SkU", "Nom", "categorie", "Sous-catégorie", "Prix unitaire", "stock_status", "short_desc"]
    ords = ["order_id_stage", "customer_id_stage", "order_date", "order_status", "payment_method_group",
            "order_total_amount", "ingest_pos"]
    parts = []
    for folder, cte, cols, sep in [("transactions", "raw_transactions_c", RAW_TX_COLS, ";"),
                                   ("catalogue", "raw_catalogue_c", cat, ","), ("orders", "raw_orders_c", ords, ",")]:
        miss = " + ".join(f"CASE WHEN {qi(c)} IS NULL OR trim(CAST({qi(c)} AS VARCHAR)) = '' THEN 1 ELSE 0 END"
                          for c in cols)
        parts.append(f"""SELECT '{folder}' AS folder, count(*) AS rows, {len(cols)} AS column_count,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {cte})) AS duplicate_rows,
               sum({miss})::BIGINT AS missing_values, 0::BIGINT AS malformed_rows, '{sep}' AS delimiter,
               '{folder}' AS dataset, 0::BIGINT AS unclosed_quotes FROM {cte}""")
    return " UNION ALL ".join(parts)


@register("csv_quality", _quality_sql(), "raw_transactions_c", "raw_catalogue_c", "raw_orders_c")
def csv_quality(spark, sf):
    """O-2.12 / O-1.7 / O-1.9 over the landing CSV folders."""
    q = FS.dataset_quality(FS.text_lines(spark, _dataset_folders(spark, sf)))
    return q.select("folder", q["rows"].cast("bigint").alias("rows"), q["column_count"].cast("int").alias("column_count"),
                    F.col("duplicate_rows").cast("bigint").alias("duplicate_rows"),
                    F.col("missing_values").cast("bigint").alias("missing_values"),
                    F.col("malformed_rows").cast("bigint").alias("malformed_rows"), "delimiter", "dataset",
                    F.col("unclosed_quotes").cast("bigint").alias("unclosed_quotes"))


def _py_canonical(h: str) -> str:
    """Independent (Python, unicodedata) statement of the header rule, used
    only to build the oracle rows."""
    import re
    import unicodedata

    from ..functions import rules
    x = unicodedata.normalize("NFKD", h.strip().lower())
    x = "".join(ch for ch in x if not unicodedata.combining(ch))
    x = re.sub(r"\s+", " ", re.sub(r"[_-]+", " ", x))
    return rules.DETECTION_HEADER_ALIASES.get(x) or re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9]+", "_", x))


def _header_sql() -> str:
    from .q_profile import RAW_TX_COLS
    cat = ["SkU", "Nom", "categorie", "Sous-catégorie", "Prix unitaire", "stock_status", "short_desc"]
    ords = ["order_id_stage", "customer_id_stage", "order_date", "order_status", "payment_method_group",
            "order_total_amount", "ingest_pos"]
    rows = []
    for folder, cols, sep in [("transactions", RAW_TX_COLS, ";"), ("catalogue", cat, ","), ("orders", ords, ",")]:
        canon = "|".join(_py_canonical(c) for c in cols)
        # the table ties the expectation to the data: a dataset without rows has no landing file
        table = {"transactions": "lineitem", "catalogue": "part", "orders": "orders"}[folder]
        rows.append(f"SELECT '{folder}' AS folder, '{sep}' AS delimiter, '{canon}' AS canonical, "
                    f"'{folder}' AS dataset FROM (SELECT count(*) AS n FROM {table}) WHERE n > 0")
    return " UNION ALL ".join(rows)


@register("header_detection", _header_sql())
def header_detection(spark, sf):
    """O-1.9 / O-1.10 per landing folder: delimiter, canonical headers
    ('|'-joined), dataset kind."""
    h = FS.file_headers(FS.text_lines(spark, _dataset_folders(spark, sf)))
    return h.select(F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("folder"), "delimiter",
                    F.concat_ws("|", "canonical").alias("canonical"), "dataset").distinct()


def _batch_sql() -> str:
    h, q = _header_sql(), _quality_sql()
    return f"""
    WITH h AS ({h}), q AS ({q}),
    a AS (SELECT (SELECT count(*) FROM h) AS files,
                 (SELECT count_if(dataset = 'needs_identification') FROM h) AS unidentified,
                 (SELECT count(*) - count(DISTINCT dataset) FROM h) AS repeated_kinds,
                 (SELECT coalesce(sum(malformed_rows), 0) FROM q) AS malformed),
    e AS (SELECT files, CASE WHEN files = 0 THEN 'no_file' WHEN unidentified > 0 THEN 'unidentified_file'
                            WHEN repeated_kinds > 0 THEN 'duplicate_dataset' WHEN malformed > 0 THEN 'malformed_file'
                       END AS error FROM a)
    SELECT error IS NULL AS valid, error, files FROM e"""


@register("batch_validation", _batch_sql(), "raw_transactions_c", "raw_catalogue_c", "raw_orders_c")
def batch_validation(spark, sf):
    """O-1.11 over one folder per dataset kind."""
    lines = FS.text_lines(spark, _dataset_folders(spark, sf))
    # One upload is one folder; its part files share a header.
    h = FS.file_headers(lines).select(F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("folder"),
                                      "dataset").distinct()
    return FS.validate_batch(h, FS.dataset_quality(lines))


@register("csv_roundtrip", """
    SELECT 'transactions' AS dataset, count(*) AS rows, count("Code Client") AS customer_ids,
           count(product_name) AS product_names FROM raw_transactions_c""", "raw_transactions_c")
def csv_roundtrip(spark, sf):
    """O-1.1: the transactions landing CSV scanned back (all-string schema,
    permissive, null tokens) -- counts equal the source rows."""
    folder = _landing(spark, sf, ["transactions"])
    cols = _cols(spark, sf, "raw_transactions")
    df = FS.read_raw_csv(spark, os.path.join(folder, "transactions"), cols, sep=";")
    return df.agg(F.lit("transactions").alias("dataset"), F.count("*").alias("rows"),
                  F.count(F.col("Code Client")).alias("customer_ids"),
                  F.count("product_name").alias("product_names"))


@register("web_export_channels", """
    SELECT channel, count(*) AS sessions,
           round(count_if(engaged)::DOUBLE / count(*)::DOUBLE * 100.0, 2) AS engagement_rate,
           sum(duration_us)::DOUBLE / count(*)::DOUBLE / 1e6 AS avg_engagement_sec
    FROM sessions_c GROUP BY 1""", "sessions_c")
def web_export_channels(spark, sf):
    """O-1.2: the acquisition report written as a web export (9 preamble
    lines + header) and scanned back."""
    t = K.canon(spark, sf).t
    rep = TR.by_channel(TR.sessions(t.events, t.nation))
    path = os.path.join(FS.landing_folder(spark, sf), "web", "acquisition")
    FS.write_web_export(rep, path, "Acquisition report")
    back = FS.read_web_export(spark, path, rep.columns)
    return back.select("channel", F.col("sessions").cast("bigint").alias("sessions"),
                       F.col("engagement_rate").cast("double").alias("engagement_rate"),
                       F.col("avg_engagement_sec").cast("double").alias("avg_engagement_sec"))
