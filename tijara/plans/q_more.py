"""Registered queries for the remaining inventory rows: samples and previews,
validated date ranges, geography map, partial months, trend envelope,
forecast history, run history and SQL-text scans (O-1.3, O-2.9, O-2.16,
O-4.9, O-5.10, O-8.16, O-12.2, O-12.9, O-12.17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drilldown as DD
from ..operators import forecast as FC
from ..operators import results as RS
from ..operators import timeseries as TS
from ..session import disk_spared, shared_path, write_shared
from . import canonical as K
from .q_cleaning import clean_tx
from .q_profile import date_coverage_of, prep_metrics_of
from .q_results import checks_of
from .q_time import regular
from ..functions import rules
from .oracle import q as oq
from .registry import REGISTRY, register

_CUT = "CAST(date_trunc('month', CAST(max(order_date) AS DATE) + 1) - INTERVAL 1 MONTH AS DATE)"


@register("rule_violation_sample", """
    SELECT order_id_stage, sku, unit_price::DOUBLE AS unit_price, line_total::DOUBLE AS line_total
    FROM clean_tx_c WHERE unit_price < 0
    ORDER BY unit_price, order_id_stage, sku, quantity, line_total LIMIT 5""", "clean_tx_c")
def rule_violation_sample(spark, sf):
    """O-2.9: a fixed-order sample of rows breaking a rule (negative price)."""
    t = clean_tx(K.canon(spark, sf)).filter(F.col("unit_price") < 0)
    return (t.orderBy("unit_price", "order_id_stage", "sku", "quantity", "line_total").limit(5)
            .select("order_id_stage", "sku", F.col("unit_price").cast("double").alias("unit_price"),
                    F.col("line_total").cast("double").alias("line_total")))


@register("preview_redacted", """
    SELECT order_id_stage,
           regexp_replace(regexp_replace(regexp_replace(customer_id_stage, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'),
                          '[0-9]', 'n', 'g') AS customer_id_stage,
           order_date, order_status, payment_method_group, order_total_amount, ingest_pos
    FROM raw_orders_c ORDER BY order_id_stage, ingest_pos LIMIT 10""", "raw_orders_c")
def preview_redacted(spark, sf):
    """O-2.16: first rows of the orders export with the customer id masked."""
    raw = K.canon(spark, sf).get("raw_orders")
    return RS.preview_redacted(raw, ["order_id_stage", "ingest_pos"], ["customer_id_stage"])


RANGE = ("1998-01-01", "1998-12-31")


@register("revenue_trend_range", f"""
    WITH o AS (SELECT * FROM realized_c WHERE CAST(order_date AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'),
    t AS (SELECT CAST(max(order_date) AS DATE) AS through FROM realized_c),
    g AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, sum(order_total_amount)::DOUBLE AS revenue,
                 count(*) AS orders FROM o GROUP BY 1)
    SELECT period, revenue, orders, last_day(period) > through AS is_partial FROM g, t""", "realized_c")
def revenue_trend_range(spark, sf):
    """O-4.9 + O-12.2: inclusive date range, validated before the job."""
    v = K.realized(K.canon(spark, sf).get("orders"))
    TS.validate_range(v, *RANGE)
    return TS.revenue_trend(v, "monthly", *RANGE)


@register("trend_meta", """
    WITH t AS (SELECT CAST(max(order_date) AS DATE) AS through FROM realized_c),
    g AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS period FROM realized_c GROUP BY 1)
    SELECT (SELECT CAST(min(order_date) AS DATE) FROM realized_c) AS available_start,
           (SELECT CAST(max(order_date) AS DATE) FROM realized_c) AS available_end,
           count_if(last_day(period) > through) AS partial_periods, count(*) AS periods,
           (SELECT CAST(max(order_date) AS DATE) FROM realized_c) AS data_through
    FROM g, t""", "realized_c")
def trend_meta(spark, sf):
    return RS.trend_meta(K.realized(K.canon(spark, sf).get("orders")))


@register("partial_months", f"""
    SELECT 'all' AS series, CAST(date_trunc('month', order_date) AS DATE) AS period,
           sum(order_total_amount)::DOUBLE AS revenue, count(*) AS orders
    FROM realized_c
    WHERE CAST(date_trunc('month', order_date) AS DATE) > (SELECT {_CUT} FROM realized_c)
    GROUP BY 1, 2""", "realized_c")
def partial_months(spark, sf):
    """O-8.16: months after the last complete month, reported (and excluded
    from the series)."""
    v = K.realized(K.canon(spark, sf).get("orders"))
    return TS.partial_months(TS.monthly_panel(v), v)


@register("region_map", f"""
    WITH o AS (SELECT * FROM orders_cust_c WHERE status_code IN ('F', 'P')),
    m AS (SELECT region_code, sum(order_total_amount)::DOUBLE AS revenue, count(*) AS orders FROM o GROUP BY 1)
    SELECT 'DZ' || g.region_code AS path_id, g.region AS label, coalesce(m.revenue, 0.0) AS revenue,
           coalesce(m.orders, 0) AS orders, g.geography_status
    FROM geo_c g LEFT JOIN m USING (region_code)""", "orders_cust_c", "geo_c")
def region_map(spark, sf):
    """O-5.10: every region boundary (``DZ<code>``) left-joined to its metrics."""
    from ..operators.common import customer_rollup
    c = K.canon(spark, sf)
    v = K.realized(c.get("orders"))
    r = customer_rollup(v, K.customer_dim(c.t), _rev=F.sum("order_total_amount"), _n=F.count("*"))
    m = r.groupBy("region_code").agg(F.sum("_rev").cast("double").alias("revenue"), F.sum("_n").alias("orders"))
    g = K.geography(c.t)
    return (g.join(m, "region_code", "left")
            .select(F.concat(F.lit("DZ"), F.col("region_code")).alias("path_id"), F.col("region").alias("label"),
                    F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("orders", F.lit(0)).alias("orders"),
                    "geography_status"))


def _history_sql() -> str:
    from .q_time import _chosen_ctes
    return f"""WITH {_chosen_ctes('panel_all_f')},
    fin AS (SELECT fc.series, fc.model, fc.period, round(fc.forecast, 4) AS forecast
            FROM f_fc fc JOIN used USING (series, model))
    SELECT u.*, 'lowest holdout MAE: ' || s.model AS reason FROM (
      SELECT series, period, 'actual' AS kind, NULL::VARCHAR AS model, y::DOUBLE AS value FROM panel_all_f
      UNION ALL SELECT series, period, 'forecast', model, forecast FROM fin) u LEFT JOIN used s USING (series)"""


@register("forecast_history", _history_sql(), "panel_all_f")
def forecast_history(spark, sf):
    """O-12.9: monthly history plus the selected model's 3-month forecast, with
    the selection reason."""
    p = regular(spark, sf)
    arr = FC.series_arrays(p)
    m = FC.metrics(FC.forecasts(FC.fit_frame(arr, "eval")))
    refit = FC.forecasts(FC.fit_frame(arr, "final"))
    sel, fin = FC.usable(m, refit), FC.final_forecast(refit, m)
    hist = p.select("series", "period", F.lit("actual").alias("kind"), F.lit(None).cast("string").alias("model"),
                    F.col("y").cast("double").alias("value"))
    fc = fin.select("series", "period", F.lit("forecast").alias("kind"), "model", F.col("forecast").alias("value"))
    reason = sel.select("series", F.concat(F.lit("lowest holdout MAE: "), F.col("model")).alias("reason"))
    return hist.unionByName(fc).join(reason, "series", "left")


#: Hours after the data's last date at which the runs of the history begin; one is reported twice.
RUN_STARTS = (1, 2, 1)


def _run_history_sql() -> str:
    prep, cov, rd = (REGISTRY[n][1] for n in ("prep_metrics", "date_coverage", "readiness"))
    starts = ", ".join(f"({h})" for h in sorted(set(RUN_STARTS)))
    return f"""
    WITH p AS ({prep}), c AS ({cov}), r AS ({rd}),
    s AS (SELECT *, CAST(CAST(c.date_max AS DATE) AS TIMESTAMP) + h * INTERVAL 1 HOUR AS started_at
          FROM p, c, r, (VALUES {starts}) v(h))
    SELECT 'run-' || substr(md5(concat_ws('|', strftime(started_at, '%Y-%m-%d %H:%M:%S.%f'), received, retained, raw_missing,
                                          cleaned_missing, date_min, date_max)), 1, 12) AS run_id,
           'transactions|catalogue|orders' AS datasets, retained AS rows, retention_pct AS retention_percentage, date_min, date_max,
           warnings AS warning_count, started_at, true AS completed
    FROM s"""


@register("run_history", _run_history_sql())
def run_history(spark, sf):
    """O-12.17: the appended run table.  Two runs on the same data begin at
    different times and so have ids of their own; the first is reported once
    more, which adds nothing.  ``completed``: the time of completion is there and
    not before the start (the time itself differs from call to call)."""
    from ..operators import ingest as IN
    from ..operators.snapshots import RunLog
    # All three read the same stored rows; each is one row, written before the next is computed.
    c = K.canon(spark, sf)
    with disk_spared(spark):
        prep = write_shared(prep_metrics_of(c), "run-metrics")
        cov = write_shared(date_coverage_of(c), "run-coverage")
        warn = write_shared(RS.readiness(checks_of(c)), "run-checks")
    row = prep.select(F.concat_ws("|", *[F.col(x).cast("string") for x in ("received", "retained", "raw_missing", "cleaned_missing")])).scalar()
    rec = write_shared(IN.run_record("run-", ["transactions", "catalogue", "orders"], prep, cov, warn).withColumn(
        "inputs", F.concat_ws("|", row, F.col("date_min").cast("string"), F.col("date_max").cast("string"))), "run-record")
    log = RunLog(spark, shared_path(spark, "runs", uuid.uuid4().hex[:12]))
    for h in RUN_STARTS:
        at = F.col("date_max").cast("date").cast("timestamp") + F.make_interval(hours=F.lit(h))
        log.append(rec.withColumn("started_at", at).withColumn("run_id", RunLog.run_id(F.col("started_at"), F.col("inputs"))).drop("inputs"))
    done = F.col("completed_at").isNotNull() & (F.col("completed_at") >= F.col("started_at"))
    return log.read().select("run_id", F.concat_ws("|", "datasets").alias("datasets"), "rows", "retention_percentage", "date_min", "date_max",
                             "warning_count", F.col("started_at").cast("timestamp_ntz").alias("started_at"), done.alias("completed"))


@register("region_revenue_sql", """
    SELECT region, sum(order_total_amount)::DOUBLE AS revenue, count(DISTINCT customer_id) AS active_customers
    FROM orders_cust_c WHERE region IS NOT NULL GROUP BY 1""", "orders_cust_c")
def region_revenue_sql(spark, sf):
    """O-1.3 + O-6.14 through the SQL API: canonical tables as temp views,
    a projection-only scan and a grouped query in SQL text (same plan as the
    DataFrame form)."""
    c = K.canon(spark, sf)
    c.get("orders").createOrReplaceTempView("tijara_orders")
    K.customer_dim(c.t).createOrReplaceTempView("tijara_customers")
    return spark.sql("""
        SELECT c.region, CAST(SUM(o.order_total_amount) AS DOUBLE) AS revenue,
               COUNT(DISTINCT o.customer_id) AS active_customers
        FROM (SELECT order_id, customer_id, order_total_amount FROM tijara_orders) o
        JOIN (SELECT customer_id, region FROM tijara_customers) c ON o.customer_id = c.customer_id
        WHERE c.region IS NOT NULL
        GROUP BY c.region""")





@register("realized_status_check", f"""
    SELECT count_if(order_status IS NOT NULL AND order_status NOT IN ({", ".join(oq(x) for x in rules.REALIZED_STATUSES)}))
             AS violations, count(*) AS rows
    FROM realized_c""", "realized_c")
def realized_status_check(spark, sf):
    """O-10.4: the realized population holds only realized statuses."""
    v = K.realized(K.canon(spark, sf).get("orders"))
    return RS.subset_violations(v, "order_status", rules.REALIZED_STATUSES)


@register("drilldown_region_types", """
    SELECT c.region, c.customer_type AS label, count(DISTINCT c.customer_id) AS customers,
           sum(c.order_total_amount)::DOUBLE AS revenue, count(c.order_id) AS orders
    FROM orders_cust_c c
    WHERE c.status_code IN ('F', 'P') AND c.customer_type IS NOT NULL
      AND c.region = (SELECT min(region) FROM orders_cust_c WHERE status_code IN ('F', 'P'))
    GROUP BY 1, 2""", "orders_cust_c")
def drilldown_region_types(spark, sf):
    """O-12.18: customer-type metrics for one selected region (the first
    region by name), computed as an aggregate result then filtered."""
    from ..operators.common import customer_rollup
    c = K.canon(spark, sf)
    r = customer_rollup(K.realized(c.get("orders")), K.customer_dim(c.t),
                        _rev=F.sum("order_total_amount"), _n=F.count("order_id"))
    per = (r.filter(F.col("customer_type").isNotNull())
           .groupBy("region", F.col("customer_type").alias("label"))
           .agg(F.count("customer_id").alias("customers"),
                F.sum("_rev").cast("double").alias("revenue"), F.sum("_n").alias("orders")))
    first = r.agg(F.min("region")).scalar()
    return RS.drill_down(per.withColumn("_sel", F.col("region") == first), _sel=True).drop("_sel")


_GROUPS = ", ".join("(" + ", ".join(x) + ")" for x in DD.SETS)
_CUBE_SQL = f"""
    SELECT region, customer_type, payment, month, GROUPING({", ".join(DD.DIMENSIONS)})::INT AS level,
           sum(amount)::DOUBLE AS revenue, count(order_id) AS orders, count(DISTINCT customer_id) AS clients,
           sum(amount)::DOUBLE / nullif(count(order_id), 0)::DOUBLE AS average_basket
    FROM (SELECT region, customer_type, payment_method_group AS payment, CAST(date_trunc('month', order_date) AS DATE) AS month,
                 order_total_amount AS amount, order_id, customer_id FROM orders_cust_c WHERE status_code IN ('F', 'P'))
    GROUP BY GROUPING SETS ({_GROUPS})"""
_cubes: dict[tuple[str, str], object] = {}


def _cube(spark, sf):
    """The drill-down table, written once for a session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _cubes:
        c = K.canon(spark, sf)
        _cubes[key] = write_shared(DD.cube(K.realized(c.get("orders")), K.customer_dim(c.t)), "drill-down")
    return _cubes[key]


@register("drilldown_cube", _CUBE_SQL, "orders_cust_c")
def drilldown_cube(spark, sf):
    """O-12.18: aggregates for every selection, by grouping sets (one scan of the facts)."""
    return _cube(spark, sf)


def _drill_sql(dim: str) -> str:
    parts = []
    for other in DD.DIMENSIONS:
        dims = (dim,) if other == dim else (dim, other)
        parts.append(f"""SELECT '{other}' AS "by", CAST({other} AS VARCHAR) AS label, revenue, orders, clients, average_basket
                         FROM c WHERE level = {DD.level(dims)} AND {dim} = (SELECT pick FROM s)""")
    pick = f"(SELECT min({dim}) AS pick FROM c WHERE level = {DD.level((dim,))})"
    return f"WITH c AS ({_CUBE_SQL}), s AS {pick} " + " UNION ALL ".join(parts)


def _register_drill(dim: str) -> None:
    @register(f"drilldown_{dim}", _drill_sql(dim), "orders_cust_c")
    def run(spark, sf):
        table = _cube(spark, sf)
        first = table.filter(F.col("level") == DD.level((dim,))).agg(F.min(dim)).scalar()
        return DD.drill_down(table, dim, first)
    run.__doc__ = f"O-12.18: metrics and breakdowns of one selected {dim} (the first by name), a filter on the drill-down table."


for _dim in DD.DIMENSIONS:
    _register_drill(_dim)
