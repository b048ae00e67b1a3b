"""Registered result-table and ingest queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from ..functions import cleaning as C
from ..operators import cleaning as CL
from ..operators import ingest as IN
from ..operators import regions as R
from ..operators import results as RS
from ..operators import snapshots as SN
from ..operators import traffic as TR
from ..session import shared_path, write_shared
from ..operators.quantiles import quantiles
from ..functions import rules
from . import canonical as K
from .oracle import CTES, payment_label_sql, shipping_class_sql
from .q_products import norm_sql
from .q_cleaning import clean_tx, typed_tx
from .registry import register

_CUT = "CAST(date_trunc('month', CAST(max(order_date) AS DATE) + 1) - INTERVAL 1 MONTH AS DATE)"


@register("overview_kpis", f"""
    WITH c AS (SELECT {_CUT} AS cm FROM realized_c)
    SELECT coalesce(sum(order_total_amount), 0)::DOUBLE AS revenue, count(order_id) AS orders,
           sum(order_total_amount)::DOUBLE / nullif(count(order_id), 0)::DOUBLE AS average_basket,
           count(DISTINCT customer_id) AS clients,
           (coalesce(sum(CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = cm THEN order_total_amount END), 0)::DOUBLE
            - coalesce(sum(CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = cm - INTERVAL 1 MONTH
                                THEN order_total_amount END), 0)::DOUBLE)
           / nullif(coalesce(sum(CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = cm - INTERVAL 1 MONTH
                                     THEN order_total_amount END), 0)::DOUBLE, 0) * 100.0 AS growth_pct
    FROM realized_c, c""", "realized_c")
def overview_kpis(spark, sf):
    return RS.overview_kpis(K.realized(K.canon(spark, sf).get("orders")))


def _valid_lines(c: K.Canon):
    v = K.realized(c.get("orders")).select("order_id")
    return K.lines_with_product(c.t, c.get("lines").join(v, "order_id", "left_semi"))


_TOPP_SQL = """
    SELECT product_name AS label, sum(line_total)::DOUBLE AS revenue, count(DISTINCT order_id) AS orders,
           sum(quantity) AS units
    FROM lines_prod_c WHERE order_id IN (SELECT order_id FROM realized_c) AND product_name IS NOT NULL {extra}
    GROUP BY 1 ORDER BY revenue DESC, label LIMIT {n}"""


@register("top_product", _TOPP_SQL.format(extra="", n=1), "lines_prod_c", "realized_c")
def top_product(spark, sf):
    """O-12.7: best product of realized orders (line totals)."""
    return RS.top_products_realized(_valid_lines(K.canon(spark, sf)), 1)


@register("top_products_list", _TOPP_SQL.format(extra="AND sku_quality = 'ok'", n=10), "lines_prod_c", "realized_c")
def top_products_list(spark, sf):
    """O-12.8: reliable catalogue matches only."""
    return RS.top_products_realized(CL_reliable(_valid_lines(K.canon(spark, sf))), 10)


def CL_reliable(df):
    return df.filter(F.col("sku_quality") == "ok")


@register("sales_page", """
    WITH u AS (
      SELECT 'customer_types' AS breakdown, customer_type AS label, sum(order_total_amount)::DOUBLE AS revenue,
             count(order_id) AS orders, sum(order_total_amount)::DOUBLE / nullif(count(order_id), 0)::DOUBLE AS average_basket
      FROM orders_cust_c WHERE status_code IN ('F', 'P') AND customer_type IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'payment_methods', payment_method_group, sum(order_total_amount)::DOUBLE, count(order_id),
             sum(order_total_amount)::DOUBLE / count(order_total_amount)::DOUBLE
      FROM realized_c WHERE payment_method_group IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'delivery_methods', m.shipping_method, sum(o.order_total_amount)::DOUBLE, count(DISTINCT o.order_id),
             sum(o.order_total_amount)::DOUBLE / count(o.order_total_amount)::DOUBLE
      FROM realized_c o LEFT JOIN (SELECT DISTINCT order_id, shipping_method FROM lines_c) m USING (order_id)
      WHERE m.shipping_method IS NOT NULL GROUP BY 2)
    SELECT *, row_number() OVER (PARTITION BY breakdown ORDER BY revenue DESC, label) AS rank,
           round(revenue / sum(revenue) OVER (PARTITION BY breakdown), 9) AS bar_share FROM u""", "orders_cust_c", "realized_c", "lines_c")
def sales_page(spark, sf):
    c = K.canon(spark, sf)
    v = K.realized(c.get("orders"))
    return RS.sales_page(v, K.customer_dim(c.t), c.get("lines")).withColumn(
        "bar_share", round_dp("bar_share", 9))


@register("scope", """
    WITH s AS (SELECT (SELECT count(*) FROM orders_c) AS orders, (SELECT count(*) FROM realized_c) AS realized_orders,
                      (SELECT count(*) FROM lines_c) AS transactions, (SELECT count(*) FROM customers_c) AS customers,
                      (SELECT sum(order_total_amount) FROM orders_c) AS amount,
                      (SELECT CAST(max(order_date) AS DATE) FROM orders_c) AS generated_at)
    SELECT orders, realized_orders, transactions, customers, 'orders|transactions|customers' AS datasets,
           'realized orders only in sales results' AS notes,
           CASE WHEN realized_orders = 0 THEN 'no realized orders in scope' ELSE '' END AS warnings, generated_at,
           'run-' || substr(md5(concat_ws('|', orders, realized_orders, transactions, customers, amount, generated_at)), 1, 12) AS run_id
    FROM s""",
          "orders_c", "realized_c", "lines_c", "customers_c")
def scope(spark, sf):
    """O-12.11.  The run id is drawn from the content (counts, amount, last
    date), so runs of one size but other content differ; the date is the data's."""
    c = K.canon(spark, sf)
    return RS.scope(c.get("orders"), K.realized(c.get("orders")), c.get("lines"), c.get("customers"), _as_of(c).cast("date"))


@register("no_data_status", """
    SELECT CASE WHEN count(*) = 0 THEN 'no_data' ELSE 'ok' END AS status,
           CASE WHEN count(*) = 0 THEN 'no realized orders in scope' END AS warning FROM realized_c""", "realized_c")
def no_data_status(spark, sf):
    return RS.no_data_status(K.realized(K.canon(spark, sf).get("orders")))


# ------------------------------------------------------------------ alerts / readiness

def _as_of(c: K.Canon):
    """The date a run is judged at: the latest order in the facts (not the clock)."""
    return c.get("orders").agg(F.max("order_date")).scalar()


#: Unit and columns that each check is about.
CHECK_UNITS = {"negative_price": ("lines", "unit_price"), "future_order_date": ("lines", "order_date"),
               "incomplete_lines": ("lines", "quantity|unit_price|line_total"), "unknown_customer": ("customers", "customer_id_stage"),
               "declining_regions": ("regions", "order_total_amount"), "suspicious_traffic": ("countries", "engagement_rate")}


def _by_code(part: int):
    out = None
    for code, x in CHECK_UNITS.items():
        out = F.when(F.col("code") == code, x[part]) if out is None else out.when(F.col("code") == code, x[part])
    return out


def _sql_by_code(part: int) -> str:
    return "CASE code " + " ".join(f"WHEN '{c}' THEN '{x[part]}'" for c, x in CHECK_UNITS.items()) + " END"


def _checks(spark, sf):
    return checks_of(K.canon(spark, sf))


def checks_of(c: K.Canon):
    ct = clean_tx(c)
    t = typed_tx(c)
    ref = CL.key_overlap(c.get("raw_orders"), c.get("customers"), "customer_id_stage", "customer_code")
    dec = R.region_decline(c.get("orders"), K.customer_dim(c.t))
    sess = TR.sessions(c.t.events, c.t.nation)
    low = TR.by_country(sess).filter(F.col("engagement_rate") < 10.0)

    def one(df, code, severity, title, count_expr):
        return df.agg(count_expr.alias("count")).select(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), "count")
    # Both checks of the clean lines in one pass over them.
    found = ct.agg(F.count_if("has_negative_price").alias("negative"), F.count_if(F.col("order_date") > _as_of(c)).alias("future"))
    check = F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.col(n).alias("count"))
                                for code, severity, title, n in (
                                    ("negative_price", "warning", "Lines with a negative price", "negative"),
                                    ("future_order_date", "error", "Order dates in the future", "future"))]))
    parts = [
        found.select(check.alias("x")).select("x.*"),
        one(t, "incomplete_lines", "warning", "Lines missing a measure",
            F.count_if(F.col("quantity").isNull() | F.col("unit_price").isNull() | F.col("line_total").isNull())),
        ref.select(F.lit("unknown_customer").alias("code"), F.lit("error").alias("severity"),
                   F.lit("Orders referencing unknown customers").alias("title"), F.col("left_only").alias("count")),
        one(dec, "declining_regions", "warning", "Regions with declining revenue", F.count_if("is_declining")),
        one(low, "suspicious_traffic", "warning", "Countries with engagement below 10 %", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CHECKS_SQL = """
    SELECT 'negative_price' AS code, 'warning' AS severity, 'Lines with a negative price' AS title,
           count_if(has_negative_price) AS count FROM clean_tx_c
    UNION ALL SELECT 'future_order_date', 'error', 'Order dates in the future',
           count_if(order_date > (SELECT max(order_date) FROM orders_c)) FROM clean_tx_c
    UNION ALL SELECT 'incomplete_lines', 'warning', 'Lines missing a measure',
           count_if(quantity IS NULL OR unit_price IS NULL OR line_total IS NULL) FROM typed_tx_c
    UNION ALL SELECT 'unknown_customer', 'error', 'Orders referencing unknown customers',
           (SELECT count(*) FROM (SELECT DISTINCT customer_id_stage AS k FROM raw_orders_c WHERE customer_id_stage IS NOT NULL)
            ANTI JOIN (SELECT DISTINCT customer_code AS k FROM customers_c) USING (k))
    UNION ALL SELECT 'declining_regions', 'warning', 'Regions with declining revenue', count_if(rr < pr) FROM (
           SELECT region, sum(CASE WHEN order_date >= d - INTERVAL 3 MONTH THEN order_total_amount ELSE 0 END) AS rr,
                  sum(CASE WHEN order_date >= d - INTERVAL 6 MONTH AND order_date < d - INTERVAL 3 MONTH
                           THEN order_total_amount ELSE 0 END) AS pr
           FROM orders_cust_c, (SELECT max(order_date) AS d FROM orders_cust_c) WHERE region IS NOT NULL GROUP BY 1)
    UNION ALL SELECT 'suspicious_traffic', 'warning', 'Countries with engagement below 10 %', count(*) FROM (
           SELECT country FROM sessions_c GROUP BY 1
           HAVING round(count_if(engaged)::DOUBLE / count(*)::DOUBLE * 100.0, 2) < 10.0)"""
_CHECK_CTES = ("orders_c", "clean_tx_c", "typed_tx_c", "raw_orders_c", "customers_c", "orders_cust_c", "sessions_c")


@register("alerts", f"""
    SELECT code, severity, title, title || ': ' || count::VARCHAR || ' ' || {_sql_by_code(0)} AS message,
           (SELECT CAST(max(order_date) AS DATE) FROM orders_c) AS observed_at, count::DOUBLE AS value, {_sql_by_code(0)} AS unit,
           count FROM ({CHECKS_SQL}) WHERE count > 0""", *_CHECK_CTES)
def alerts(spark, sf):
    """O-12.10: violated rules with severity, message, date, value and unit."""
    return RS.alerts(_checks(spark, sf).withColumn("unit", _by_code(0)), _as_of(K.canon(spark, sf)).cast("date"))


@register("readiness_issues", f"""
    SELECT code, title || ': ' || count::VARCHAR || ' ' || {_sql_by_code(0)} AS message, severity, count,
           {_sql_by_code(1)} AS columns FROM ({CHECKS_SQL}) WHERE count > 0""", *_CHECK_CTES)
def readiness_issues(spark, sf):
    """O-12.14: one row per issue with its message, count and columns."""
    c = _checks(spark, sf).withColumn("unit", _by_code(0)).withColumn("columns", _by_code(1)).filter("count > 0")
    return c.select("code", RS.issue_message().alias("message"), "severity", "count", "columns")


@register("sales_summary", f"""
    WITH c AS (SELECT {_CUT} AS cm FROM realized_c)
    SELECT coalesce(sum(order_total_amount), 0)::DOUBLE AS total_revenue, count(order_id) AS total_orders,
           sum(order_total_amount)::DOUBLE / nullif(count(order_id), 0)::DOUBLE AS average_basket,
           (coalesce(sum(CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = cm THEN order_total_amount END), 0)::DOUBLE
            - coalesce(sum(CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = cm - INTERVAL 1 MONTH
                                THEN order_total_amount END), 0)::DOUBLE)
           / nullif(coalesce(sum(CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = cm - INTERVAL 1 MONTH
                                     THEN order_total_amount END), 0)::DOUBLE, 0) * 100.0 AS growth_pct,
           CAST(min(order_date) AS DATE) AS period_start, CAST(max(order_date) AS DATE) AS period_end,
           count(DISTINCT CASE WHEN CAST(date_trunc('month', order_date) AS DATE) > cm
                               THEN CAST(date_trunc('month', order_date) AS DATE) END) AS partial_months
    FROM realized_c, c""", "realized_c")
def sales_summary(spark, sf):
    """O-12.3 envelope: totals, growth, period and partial months (the trend is
    ``revenue_trend_monthly``, the breakdowns are ``sales_page``)."""
    return RS.sales_summary(K.realized(K.canon(spark, sf).get("orders")))


_RAW_SHAPES = {"transactions": ("raw_transactions", "raw_transactions_c"), "catalogue": ("raw_catalogue", "raw_catalogue_c"),
               "orders": ("raw_orders", "raw_orders_c")}
_SHAPE_SQL = " UNION ALL ".join(f"""
    SELECT '{n}' AS dataset, column_name AS "column", CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE 'int' END AS type,
           (SELECT count(*) FROM {cte}) AS rows
    FROM (SELECT unnest(json_keys(j)) AS column_name FROM (SELECT to_json(t) AS j FROM {cte} t LIMIT 1)) k,
         LATERAL (SELECT CASE WHEN k.column_name = 'ingest_pos' THEN 'INTEGER' ELSE 'VARCHAR' END AS column_type) x"""
                                for n, (_, cte) in _RAW_SHAPES.items())


@register("table_shapes", _SHAPE_SQL, "raw_transactions_c", "raw_catalogue_c", "raw_orders_c")
def table_shapes(spark, sf):
    """O-2.1: rows, columns and types of the exports, one row per column."""
    c = K.canon(spark, sf)
    return RS.table_shapes({n: c.get(src) for n, (src, _) in _RAW_SHAPES.items()})


@register("readiness", f"""
    WITH c AS ({CHECKS_SQL}),
    a AS (SELECT count_if(count > 0 AND severity = 'error') AS errors,
                 count_if(count > 0 AND severity = 'warning') AS warnings FROM c)
    SELECT CASE WHEN errors > 0 THEN 'needs_attention' WHEN warnings > 0 THEN 'ready_with_warnings'
                ELSE 'ready' END AS status, errors, warnings FROM a""", *_CHECK_CTES)
def readiness(spark, sf):
    """O-12.14."""
    return RS.readiness(_checks(spark, sf))


#: Label and description of each cleaning rule.
ACTIONS = {"money_text": ("Money text", "French number text to decimals"), "whitespace": ("White space", "names trimmed, inner runs to one space"),
           "payment_labels": ("Payment labels", "raw labels to the standard ones"),
           "shipping_classes": ("Shipping classes", "raw labels to delivery classes"),
           "duplicates_removed": ("Duplicates", "identical rows removed"),
           "incomplete_removed": ("Incomplete lines", "rows without quantity, price or total removed")}


def _action_sql(part: int) -> str:
    return "CASE code " + " ".join(f"WHEN '{c}' THEN '{x[part]}'" for c, x in ACTIONS.items()) + " END"


def _action(part: int):
    return F.element_at(C.literal_map({c: x[part] for c, x in ACTIONS.items()}), F.col("code"))


@register("cleaning_actions", f"""
    WITH r AS (SELECT * FROM raw_transactions_c)
    SELECT *, {_action_sql(0)} AS label, {_action_sql(1)} AS description FROM (
      SELECT 'money_text' AS code,
             count_if("Montant total de la commande" IS NOT NULL OR "Montant de l’expédition commande" IS NOT NULL)
               AS affected_rows,
             count("Montant total de la commande") + count("Montant de l’expédition commande") AS affected_cells
      FROM r
      UNION ALL SELECT 'whitespace', count_if(product_name IS DISTINCT FROM {norm_sql('product_name')}),
             count_if(product_name IS DISTINCT FROM {norm_sql('product_name')}) FROM r
      UNION ALL SELECT 'payment_labels',
             count_if("Titre moyen du paiement" IS DISTINCT FROM {payment_label_sql('"Titre moyen du paiement"')}),
             count_if("Titre moyen du paiement" IS DISTINCT FROM {payment_label_sql('"Titre moyen du paiement"')}) FROM r
      UNION ALL SELECT 'shipping_classes',
             count_if("Titre de la méthode d’expédition" IS DISTINCT FROM {shipping_class_sql('"Titre de la méthode d’expédition"')}),
             count_if("Titre de la méthode d’expédition" IS DISTINCT FROM {shipping_class_sql('"Titre de la méthode d’expédition"')})
      FROM r
      UNION ALL SELECT 'duplicates_removed', (SELECT count(*) FROM typed_tx_c) * 0
             + (SELECT count(*) FROM raw_transactions_c) - (SELECT count(*) FROM typed_tx_c), 0
      UNION ALL SELECT 'incomplete_removed',
             count_if(quantity IS NULL OR unit_price IS NULL OR line_total IS NULL), 0 FROM typed_tx_c)""",
          "raw_transactions_c", "typed_tx_c")
def cleaning_actions(spark, sf):
    """O-12.13: rows / cells each cleaning rule changed or removed, observed while the clean table is written."""
    c = K.canon(spark, sf)
    _clean, actions = CL.clean_with_actions(c.get("raw_transactions"), c.get("raw_catalogue"))
    return actions.withColumns({"label": _action(0), "description": _action(1)})


#: Rules that cleaning leaves to a confirmation: dataset, rule, by whom, what is counted.
DEFERRED = [
    ("transactions", "negative_unit_price", "business"), ("transactions", "unit_price_outlier", "statistical"),
    ("transactions", "order_not_in_export", "database"), ("orders", "status_not_mapped", "business"),
    ("orders", "order_total_outlier", "statistical"), ("orders", "customer_not_known", "database"),
    ("catalogue", "price_missing", "business"), ("catalogue", "sku_repeated", "database")]
#: An outlier lies more than this many quartile ranges outside the quartiles.
FENCE = 3.0


def _outliers(df, value):
    """Number of values outside the fences (exact quartiles)."""
    q = quantiles(df, [], value, [0.25, 0.75], linear=True).select(F.col("q")[0].alias("_a"), F.col("q")[1].alias("_b"))
    lo, hi = F.col("_a") - FENCE * (F.col("_b") - F.col("_a")), F.col("_b") + FENCE * (F.col("_b") - F.col("_a"))
    q = q.agg(F.struct(F.max(lo).alias("lo"), F.max(hi).alias("hi"))).scalar()
    return df.agg(F.count_if((value < q["lo"]) | (value > q["hi"])).alias("rows"))


def _fence_sql(value: str, table: str) -> str:
    return f"""(SELECT count_if(v < a - {FENCE} * (b - a) OR v > b + {FENCE} * (b - a)) FROM (SELECT {value} AS v FROM {table}),
               (SELECT quantile_cont({value}, 0.25) AS a, quantile_cont({value}, 0.75) AS b FROM {table}))"""


_DEFERRED_SQL = {
    "negative_unit_price": "(SELECT count_if(unit_price < 0) FROM clean_tx_c)",
    "unit_price_outlier": _fence_sql("unit_price::DOUBLE", "clean_tx_c"),
    "order_not_in_export": """(SELECT count(*) FROM (SELECT DISTINCT order_id_stage FROM clean_tx_c WHERE order_id_stage IS NOT NULL)
        ANTI JOIN raw_orders_c USING (order_id_stage))""",
    "status_not_mapped": f"""(SELECT count(*) FROM raw_orders_c WHERE order_status IS NULL OR order_status NOT IN
        ({", ".join("'" + s.replace("'", "''") + "'" for s in rules.STATUS_GROUPS)}))""",
    "order_total_outlier": _fence_sql("TRY_CAST(order_total_amount AS DOUBLE)", "raw_orders_c"),
    "customer_not_known": """(SELECT count(*) FROM raw_orders_c o WHERE customer_id_stage IS NOT NULL
        AND customer_id_stage NOT IN (SELECT customer_code FROM customers_c WHERE customer_code IS NOT NULL))""",
    "price_missing": """(SELECT count(*) FROM raw_catalogue_c WHERE "Prix unitaire" IS NULL)""",
    "sku_repeated": """(SELECT count(*) FROM (SELECT "SkU" FROM raw_catalogue_c WHERE "SkU" IS NOT NULL GROUP BY 1 HAVING count(*) > 1))""",
}


@register("deferred_rules", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, '{r}' AS rule, '{w}' AS confirmation, {_DEFERRED_SQL[r]}::BIGINT AS rows" for d, r, w in DEFERRED),
    "clean_tx_c", "raw_orders_c", "raw_catalogue_c", "customers_c")
def deferred_rules(spark, sf):
    """O-12.14: rules that stay visible because they need a business, statistical or database confirmation, with the rows they concern."""
    c = K.canon(spark, sf)
    tx, orders, cat = clean_tx(c), c.get("raw_orders"), c.get("raw_catalogue")
    tx = write_shared(tx.select("order_id_stage", "unit_price"), "deferred-lines")
    known = c.get("customers").select(F.col("customer_code").alias("customer_id_stage")).filter("customer_id_stage IS NOT NULL").distinct()
    total = F.col("order_total_amount").try_cast("double")
    n = F.count("*").alias("rows")
    found = {
        "negative_unit_price": tx.agg(F.count_if(F.col("unit_price") < 0).alias("rows")),
        "unit_price_outlier": _outliers(tx, F.col("unit_price").cast("double")),
        "order_not_in_export": tx.select("order_id_stage").filter("order_id_stage IS NOT NULL").distinct().join(
            orders.select("order_id_stage").distinct(), "order_id_stage", "left_anti").agg(n),
        "status_not_mapped": orders.filter(F.col("order_status").isNull() | ~F.col("order_status").isin(list(rules.STATUS_GROUPS))).agg(n),
        "order_total_outlier": _outliers(orders, total),
        "customer_not_known": orders.filter("customer_id_stage IS NOT NULL").join(known, "customer_id_stage", "left_anti").agg(n),
        "price_missing": cat.filter(F.col("Prix unitaire").isNull()).agg(n),
        "sku_repeated": cat.filter(F.col("SkU").isNotNull()).groupBy("SkU").count().filter("count > 1").agg(n),
    }
    out = None
    for d, r, w in DEFERRED:
        row = found[r].select(F.lit(d).alias("dataset"), F.lit(r).alias("rule"), F.lit(w).alias("confirmation"), F.col("rows").cast("bigint").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------------ incremental load

def _upsert_frames(c: K.Canon):
    """Fixture over all orders.  The store lacks the keys 0 mod 4.  In the
    batch, amounts change on keys 0 mod 9, a value moves from the status to the
    payment column on keys 0 mod 11 (null against value both ways), keys 0 mod
    31 come as null, and keys 0 mod 50 come twice with different amounts."""
    k = F.col("order_id")
    o = c.get("orders").select("order_id", "customer_id", "order_date", "order_status", "payment_method_group",
                               "order_total_amount")
    moved = F.pmod(k, F.lit(11)) == 0
    none = F.lit(None).cast("string")
    stored = o.filter(F.pmod(k, F.lit(4)) != 0).withColumns({
        "order_status": F.when(moved, F.lit("x")).otherwise(F.col("order_status")),
        "payment_method_group": F.when(moved, none).otherwise(F.col("payment_method_group"))})
    copies = F.when(F.pmod(k, F.lit(50)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    change = F.when(F.pmod(k, F.lit(9)) == 0, 1).otherwise(0) + F.col("pos") * 2
    batch = o.withColumn("pos", F.explode(copies)).withColumns({
        "order_status": F.when(moved, none).otherwise(F.col("order_status")),
        "payment_method_group": F.when(moved, F.lit("x")).otherwise(F.col("payment_method_group")),
        "order_total_amount": (F.col("order_total_amount") + change).cast("decimal(12,2)")})
    return stored, batch.withColumn("order_id", F.when(F.pmod(k, F.lit(31)) != 0, k))


UPSERT_COLS = ["customer_id", "order_date", "order_status", "payment_method_group", "order_total_amount"]
CTES["upsert_s"] = (["orders_c"], """
    SELECT order_id, customer_id, order_date, CASE WHEN order_id % 11 = 0 THEN 'x' ELSE order_status END AS order_status,
           CASE WHEN order_id % 11 <> 0 THEN payment_method_group END AS payment_method_group, order_total_amount
    FROM orders_c WHERE order_id % 4 <> 0""")
CTES["upsert_b"] = (["orders_c"], """
    SELECT CASE WHEN order_id % 31 <> 0 THEN order_id END AS order_id, customer_id, order_date,
           CASE WHEN order_id % 11 <> 0 THEN order_status END AS order_status,
           CASE WHEN order_id % 11 = 0 THEN 'x' ELSE payment_method_group END AS payment_method_group,
           CAST(order_total_amount + CASE WHEN order_id % 9 = 0 THEN 1 ELSE 0 END + pos * 2 AS DECIMAL(12,2)) AS order_total_amount,
           pos
    FROM orders_c JOIN (VALUES (0), (1)) v(pos) ON pos = 0 OR order_id % 50 = 0""")
CTES["upsert_c"] = (["upsert_s", "upsert_b"], """
    WITH s AS (SELECT * FROM upsert_s),
    r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY pos) AS nth FROM upsert_b),
    b AS (SELECT * FROM r WHERE order_id IS NOT NULL AND nth = 1)
    SELECT coalesce(b.order_id, s.order_id) AS order_id,
           CASE WHEN s.order_id IS NULL THEN 'inserted' WHEN b.order_id IS NULL THEN 'stored_only'
                WHEN (b.customer_id, b.order_date, b.order_status, b.payment_method_group, b.order_total_amount)
                     IS DISTINCT FROM (s.customer_id, s.order_date, s.order_status, s.payment_method_group,
                                       s.order_total_amount) THEN 'updated'
                ELSE 'unchanged' END AS action
    FROM b FULL JOIN s ON b.order_id = s.order_id
    UNION ALL SELECT order_id, 'rejected' FROM r WHERE order_id IS NULL OR nth > 1""")


@register("upsert_actions", "SELECT order_id, action FROM upsert_c", "upsert_c")
def upsert_actions(spark, sf):
    """O-12.16: inserted / updated / unchanged / stored_only per order key, and rejected batch rows."""
    stored, batch = _upsert_frames(K.canon(spark, sf))
    return IN.classify_upsert(stored, batch, "order_id", UPSERT_COLS, ["pos"])


@register("import_summary", "SELECT action, count(*) AS records FROM upsert_c GROUP BY 1", "upsert_c")
def import_summary(spark, sf):
    """O-12.15."""
    stored, batch = _upsert_frames(K.canon(spark, sf))
    return IN.import_summary(IN.classify_upsert(stored, batch, "order_id", UPSERT_COLS, ["pos"]))


@register("upsert_snapshot", """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY pos) AS nth FROM upsert_b WHERE order_id IS NOT NULL)
    SELECT order_id, order_status, order_total_amount::DOUBLE AS order_total_amount FROM upsert_s
    WHERE order_id NOT IN (SELECT order_id FROM b)
    UNION ALL SELECT order_id, order_status, order_total_amount::DOUBLE FROM b WHERE nth = 1""", "upsert_s", "upsert_b")
def upsert_snapshot(spark, sf):
    """O-12.16 result: the bucketed snapshot after the load (batch wins by key, every key once)."""
    stored, batch = _upsert_frames(K.canon(spark, sf))
    store = SN.BucketedSnapshot.create(stored, shared_path(spark, "snapshots", "orders-" + uuid.uuid4().hex[:12]), "order_id")
    store.upsert(batch, "load-1", UPSERT_COLS, ["pos"])
    return store.read().select("order_id", "order_status", F.col("order_total_amount").cast("double").alias("order_total_amount"))


@register("transaction_accounting", """
    WITH po AS (SELECT l.order_id, bool_or(p.p_partkey IS NULL) AS unk, count(*) AS n
                FROM lines_c l LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 23 <> 0) p ON l.sku = p.p_partkey
                GROUP BY 1),
    j AS (SELECT po.n, o.order_id % 4 <> 0 AS st, po.unk OR c.c_custkey IS NULL AS rv
          FROM po JOIN orders_c o USING (order_id)
          LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 29 <> 0) c ON o.customer_id = c.c_custkey)
    SELECT count_if(NOT st AND NOT rv) AS new_orders,
           coalesce(sum(CASE WHEN NOT st AND NOT rv THEN n END), 0)::BIGINT AS new_transaction_rows,
           count_if(st) AS existing_orders_skipped, count_if(NOT st AND rv) AS review_orders,
           coalesce(sum(CASE WHEN NOT st AND rv THEN n END), 0)::BIGINT AS review_transaction_rows
    FROM j""", "lines_c", "orders_c")
def transaction_accounting(spark, sf):
    """O-12.15 (transactions): new / skipped / review lines of a batch of all
    lines; the store lacks some orders, skus and customers."""
    c = K.canon(spark, sf)
    stored, _ = _upsert_frames(c)
    skus = c.t.part.filter(F.pmod("p_partkey", F.lit(23)) != 0).select(F.col("p_partkey").alias("sku"))
    known = c.t.customer.filter(F.pmod("c_custkey", F.lit(29)) != 0).select(F.col("c_custkey").alias("customer_id"))
    out = IN.transaction_accounting(c.get("lines"), c.get("orders"), stored, skus, known)
    return out.select(*[F.col(x).cast("bigint").alias(x) for x in out.columns])
