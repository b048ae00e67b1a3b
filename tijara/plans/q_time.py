"""Registered time-series and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.cleaning import round_dp
from ..operators import arima as AR
from ..operators import forecast as FC
from ..operators import timeseries as TS
from ..operators.regions import complete_month_cutoff
from ..session import write_shared
from . import canonical as K
from .oracle import CTES
from .registry import register

_CUT = "CAST(date_trunc('month', CAST(max(order_date) AS DATE) + 1) - INTERVAL 1 MONTH AS DATE)"

CTES["panel_all_c"] = (["realized_c"], f"""
    SELECT 'all' AS series, CAST(date_trunc('month', order_date) AS DATE) AS period,
           sum(order_total_amount) AS y, count(*) AS orders
    FROM realized_c WHERE order_date IS NOT NULL
      AND CAST(date_trunc('month', order_date) AS DATE) <= (SELECT {_CUT} FROM realized_c)
    GROUP BY 1, 2""")
CTES["panel_region_c"] = (["orders_cust_c"], f"""
    SELECT CAST(region AS VARCHAR) AS series, CAST(date_trunc('month', order_date) AS DATE) AS period,
           sum(order_total_amount) AS y, count(*) AS orders
    FROM orders_cust_c WHERE status_code IN ('F', 'P') AND order_date IS NOT NULL
      AND CAST(date_trunc('month', order_date) AS DATE) <=
          (SELECT {_CUT} FROM orders_cust_c WHERE status_code IN ('F', 'P'))
    GROUP BY 1, 2""")


def _line_panel_sql(key: str) -> str:
    return f"""
    WITH j AS (SELECT l.{key} AS k, o.order_date, l.line_total FROM lines_prod_c l JOIN realized_c o USING (order_id)
               WHERE l.{key} IS NOT NULL)
    SELECT CAST(k AS VARCHAR) AS series, CAST(date_trunc('month', order_date) AS DATE) AS period,
           sum(line_total) AS y, count(*) AS orders
    FROM j WHERE order_date IS NOT NULL
      AND CAST(date_trunc('month', order_date) AS DATE) <= (SELECT {_CUT} FROM realized_c)
    GROUP BY 1, 2"""


CTES["panel_category_c"] = (["lines_prod_c", "realized_c"], _line_panel_sql("category"))
CTES["panel_product_c"] = (["lines_prod_c", "realized_c"], _line_panel_sql("sku"))


def _regular_sql(cte: str) -> str:
    """The month grid of every series, from its first month to the last complete month."""
    return f"""
    SELECT g.series, g.period, coalesce(p.y, 0) AS y, coalesce(p.orders, 0) AS orders
    FROM (SELECT series, CAST(unnest(generate_series(a, CAST((SELECT {_CUT} FROM realized_c) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period
          FROM (SELECT series, CAST(min(period) AS TIMESTAMP) AS a FROM {cte} GROUP BY 1)) g
    LEFT JOIN {cte} p ON p.series = g.series AND p.period = g.period"""


for _p in ("all", "region", "category", "product"):
    CTES[f"panel_{_p}_f"] = ([f"panel_{_p}_c", "realized_c"], _regular_sql(f"panel_{_p}_c"))


def line_panel(spark, sf, key: str = "category"):
    """Product panel: realized line revenue per ``key`` (sku or a product
    attribute) and month.  Lines meet order dates by order id and are rolled up
    per sku and month before they meet the catalogue."""
    c = K.canon(spark, sf)
    o = K.realized(c.get("orders"))
    per_sku = TS.monthly_panel(c.get("lines").join(o.select("order_id", "order_date"), "order_id")
                               .filter(F.col("sku").isNotNull()), "sku", value="line_total")
    p = TS.complete_months(per_sku, o)
    if key == "sku":
        return p
    prod = K.products(c.t).select(F.col("sku").cast("string").alias("series"), F.col(key).cast("string").alias("_k"))
    return (p.join(prod, "series").filter(F.col("_k").isNotNull())
            .groupBy(F.col("_k").alias("series"), "period").agg(F.sum("y").alias("y"), F.sum("orders").alias("orders")))


def category_panel(spark, sf):
    return line_panel(spark, sf, "category")


def regular(spark, sf, key: str | None = None):
    """The panel on a full month grid up to the last complete month, written
    once: every branch of a forecast reads it instead of the facts."""
    p = line_panel(spark, sf, key) if key in ("category", "sku") else panel(spark, sf, key)
    cutoff = complete_month_cutoff(_valid(spark, sf).agg(F.max("order_date")).scalar())
    return write_shared(TS.fill_gaps(p, cutoff), f"panel-{key or 'all'}")


def _valid(spark, sf):
    return K.realized(K.canon(spark, sf).get("orders"))


def panel(spark, sf, key: str | None = None):
    c = K.canon(spark, sf)
    o = K.realized(c.get("orders"))
    if key is None:
        return TS.complete_months(TS.monthly_panel(o), o)
    # Orders are rolled up per customer and month before they meet the customer dimension.
    per = TS.complete_months(TS.monthly_panel(o.filter(F.col("customer_id").isNotNull()), "customer_id"), o)
    dim = K.customer_dim(c.t).select(F.col("customer_id").cast("string").alias("series"), F.col(key).cast("string").alias("_k"))
    return (per.join(dim, "series").groupBy(F.col("_k").alias("series"), "period")
            .agg(F.sum("y").alias("y"), F.sum("orders").alias("orders")))


@register("monthly_revenue", """
    SELECT CAST(date_trunc('month', order_date) AS DATE) AS period, sum(order_total_amount)::DOUBLE AS revenue,
           count(*) AS orders
    FROM realized_c WHERE order_date IS NOT NULL GROUP BY 1""", "realized_c")
def monthly_revenue(spark, sf):
    p = TS.monthly_panel(_valid(spark, sf))
    return p.select("period", F.col("y").cast("double").alias("revenue"), "orders")


@register("monthly_revenue_by_region", """
    SELECT series, period, y::DOUBLE AS revenue, orders FROM panel_region_c""", "panel_region_c")
def monthly_revenue_by_region(spark, sf):
    return panel(spark, sf, "region").select("series", "period", F.col("y").cast("double").alias("revenue"),
                                             "orders")


def _trend_sql(trunc: str, end: str) -> str:
    return f"""
    WITH t AS (SELECT CAST(max(order_date) AS DATE) AS through FROM realized_c),
    g AS (SELECT CAST({trunc} AS DATE) AS period, sum(order_total_amount)::DOUBLE AS revenue, count(*) AS orders
          FROM realized_c GROUP BY 1)
    SELECT period, revenue, orders, {end} > through AS is_partial FROM g, t"""


@register("revenue_trend_daily", _trend_sql("CAST(order_date AS DATE)", "period"), "realized_c")
def revenue_trend_daily(spark, sf):
    return TS.revenue_trend(_valid(spark, sf), "daily")


@register("revenue_trend_weekly", _trend_sql("date_trunc('week', order_date)", "period + 6"), "realized_c")
def revenue_trend_weekly(spark, sf):
    return TS.revenue_trend(_valid(spark, sf), "weekly")


@register("revenue_trend_monthly", _trend_sql("date_trunc('month', order_date)", "last_day(period)"),
          "realized_c")
def revenue_trend_monthly(spark, sf):
    return TS.revenue_trend(_valid(spark, sf), "monthly")


@register("growth", """
    SELECT series, period, y::DOUBLE AS y,
           (y::DOUBLE - lag(y) OVER w::DOUBLE) / nullif(lag(y) OVER w::DOUBLE, 0) * 100.0 AS growth_pct
    FROM panel_all_c WINDOW w AS (PARTITION BY series ORDER BY period)""", "panel_all_c")
def growth(spark, sf):
    return TS.growth(panel(spark, sf))


@register("growth_by_region", """
    SELECT series, period, y::DOUBLE AS y,
           (y::DOUBLE - lag(y) OVER w::DOUBLE) / nullif(lag(y) OVER w::DOUBLE, 0) * 100.0 AS growth_pct
    FROM panel_region_f WINDOW w AS (PARTITION BY series ORDER BY period)""", "panel_region_f")
def growth_by_region(spark, sf):
    return TS.growth(regular(spark, sf, "region"))


@register("log_diff", """
    SELECT series, period, round(CASE WHEN y > 0 THEN ln(y::DOUBLE) END, 9) AS log_y,
           round(CASE WHEN y > 0 THEN ln(y::DOUBLE) END
             - lag(CASE WHEN y > 0 THEN ln(y::DOUBLE) END) OVER (PARTITION BY series ORDER BY period), 9) AS diff_log_y
    FROM panel_all_c""", "panel_all_c")
def log_diff(spark, sf):
    return TS.log_diff(panel(spark, sf))


def _decomp_sql(panel_cte: str, model: str) -> str:
    add = model == "additive"
    d = "y::DOUBLE - trend" if add else "y::DOUBLE / trend"
    s = "s - m" if add else "s / m"
    r = "y::DOUBLE - trend - seasonal" if add else "y::DOUBLE / (trend * seasonal)"
    return f"""
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) AS i,
                      count(*) OVER (PARTITION BY series) AS n FROM {panel_cte}),
    t AS (SELECT *, (lag(y, 6) OVER w + 2 * sum(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                     + lead(y, 6) OVER w)::DOUBLE / 24.0 AS trend, (i - 1) % 12 AS pos
          FROM p WHERE n >= 24 WINDOW w AS (PARTITION BY series ORDER BY i)),
    d AS (SELECT *, {d} AS dd FROM t),
    sp AS (SELECT series, pos, list_reduce(list(dd ORDER BY i), lambda a, x: a + x, 0.0::DOUBLE) / count(*)::DOUBLE AS s
           FROM d WHERE dd IS NOT NULL GROUP BY 1, 2),
    sm AS (SELECT series, list_reduce(list(s ORDER BY pos), lambda a, x: a + x, 0.0::DOUBLE) / count(*)::DOUBLE AS m
           FROM sp GROUP BY 1),
    ss AS (SELECT series, pos, {s} AS seasonal FROM sp JOIN sm USING (series))
    SELECT series, period, y::DOUBLE AS y, trend, seasonal, {r} AS resid
    FROM d JOIN ss USING (series, pos)"""


@register("decompose_additive", _decomp_sql("panel_all_c", "additive"), "panel_all_c")
def decompose_additive(spark, sf):
    return TS.decompose(panel(spark, sf), "additive")


@register("decompose_multiplicative", _decomp_sql("panel_all_c", "multiplicative"), "panel_all_c")
def decompose_multiplicative(spark, sf):
    return TS.decompose(panel(spark, sf), "multiplicative")


@register("decompose_additive_by_region", _decomp_sql("panel_region_f", "additive"), "panel_region_f")
def decompose_additive_by_region(spark, sf):
    return TS.decompose(regular(spark, sf, "region"), "additive")


def _acf_sql(panel_cte: str) -> str:
    return f"""
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period) AS i FROM {panel_cte}),
    st AS (SELECT series, sum(y)::DOUBLE / count(y)::DOUBLE AS m, count(y) AS n FROM p GROUP BY 1),
    d AS (SELECT series, i, y::DOUBLE - m AS d FROM p JOIN st USING (series)),
    pr AS (SELECT a.series, k, sum(a.d * b.d) AS c
           FROM d a, range(0, 25) r(k), d b WHERE b.series = a.series AND b.i = a.i - k GROUP BY 1, 2),
    r AS (SELECT pr.series, k, n, c / c0 AS r FROM pr JOIN (SELECT series, c AS c0 FROM pr WHERE k = 0) z
          USING (series) JOIN st USING (series) WHERE k < n),
    cu AS (SELECT *, sum(CASE WHEN k > 0 THEN r * r ELSE 0.0 END)
                     OVER (PARTITION BY series ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cs
           FROM r)
    SELECT series, k, round(r, 9) AS acf,
           round(CASE WHEN k > 0 THEN 1.96 * sqrt((1.0 + 2.0 * coalesce(cs, 0.0)) / n::DOUBLE) END, 9) AS band
    FROM cu"""


@register("acf", _acf_sql("panel_all_c"), "panel_all_c")
def acf(spark, sf):
    return TS.acf(panel(spark, sf))


@register("acf_by_region", _acf_sql("panel_region_f"), "panel_region_f")
def acf_by_region(spark, sf):
    return TS.acf(regular(spark, sf, "region"))


# ---------------------------------------------------------------- forecasts

_SES_FOLD = """list_reduce(train, lambda acc, y: struct_pack(
                 a := alpha * y + (1.0 - alpha) * acc.a, b := (1.0 - alpha) * acc.b,
                 syy := acc.syy + (y - acc.a) * (y - acc.a), sby := acc.sby + acc.b * (y - acc.a),
                 sbb := acc.sbb + acc.b * acc.b),
               struct_pack(a := 0.0::DOUBLE, b := 1.0::DOUBLE, syy := 0.0::DOUBLE, sby := 0.0::DOUBLE,
                           sbb := 0.0::DOUBLE))"""

_TAGS = {"ARIMA(1,1,0)": "a110", "ARIMA(1,1,1)": "a111", "ARIMA(2,1,1)": "a211"}


def _arima_sql(px: str, model: str) -> str:
    """Exact likelihood by the Kalman recursion over the list of differences: a grid, rounds of finer grids around the
    best point, and forecasts from the predicted state."""
    tag, spec = px + _TAGS[model], AR.SPECS[model]
    err = "(z[t] - acc.a1)"
    q = "(1.0 - phi2)"
    p11 = f"(((1.0 + theta * theta) * {q} + 2.0 * phi1 * theta) / ((1.0 + phi2) * ({q} - phi1) * ({q} + phi1)))"
    fold = f"""list_reduce(range(1, len(z) + 1), lambda acc, t: struct_pack(
                 a1 := phi1 * z[t] + (acc.a2 + acc.p12 * {err} / acc.f), a2 := phi2 * z[t],
                 f := 1.0 + (acc.p22 - acc.p12 * acc.p12 / acc.f), p12 := theta, p22 := theta * theta,
                 sse := acc.sse + {err} * {err} / acc.f, logs := acc.logs + ln(acc.f)),
               struct_pack(a1 := 0.0::DOUBLE, a2 := 0.0::DOUBLE, f := {p11}, p12 := (phi1 * phi2 * {p11} + theta) / {q},
                           p22 := phi2 * phi2 * {p11} + theta * theta, sse := 0.0::DOUBLE, logs := 0.0::DOUBLE))"""
    obj = "len(z)::DOUBLE * ln(greatest(st.sse / len(z)::DOUBLE, 1e-300)) + st.logs"

    def points(div: int, source: str, k1: str, k2: str, kt: str) -> str:
        l1, l2, lt = spec.limits(div)
        return f"""(SELECT *, {fold} AS st FROM (
                     SELECT *, k1::DOUBLE / {float(div)} AS phi1, k2::DOUBLE / {float(div)} AS phi2, kt::DOUBLE / {float(div)} AS theta
                     FROM (SELECT series, z, {k1} AS k1, {k2} AS k2, {kt} AS kt FROM {source})
                     WHERE abs(k1) <= {l1} AND abs(k2) <= {l2} AND abs(kt) <= {lt}
                       AND k2 + k1 < {div} AND k2 - k1 < {div} AND k2 > -{div}))"""

    best = (f"arg_min(struct_pack(k1 := k1, k2 := k2, kt := kt, phi1 := phi1, phi2 := phi2, a1 := st.a1, a2 := st.a2), "
            f"struct_pack(o := {obj}, k1 := k1, k2 := k2, kt := kt)) AS b")
    l1, l2, lt = spec.limits(spec.div)
    least = f"len(z) > {spec.p}" + ("" if spec.q else " AND len(list_filter(z[1:len(z) - 1], lambda v: v <> 0)) > 0")
    grid = f"{px}z, range(-{l1}, {l1 + 1}) x(i), range(-{l2}, {l2 + 1}) y(j), range(-{lt}, {lt + 1}) w(l) WHERE {least}"
    out = [f"{tag}r0 AS (SELECT series, any_value(z) AS z, {best} FROM {points(spec.div, grid, 'i', 'j', 'l')} GROUP BY 1)"]
    win = f"range(-{spec.window}, {spec.window + 1})"
    for i, div in enumerate(spec.divs()):
        src = f"{tag}r{i}, {win} x(i), {win if spec.p == 2 else 'range(0, 1)'} y(j), {win if spec.q else 'range(0, 1)'} w(l)"
        pts = points(div, src, f"b.k1 * {AR.RATIO} + i", f"b.k2 * {AR.RATIO} + j", f"b.kt * {AR.RATIO} + l")
        out.append(f"{tag}r{i + 1} AS (SELECT series, any_value(z) AS z, {best} FROM {pts} GROUP BY 1)")
    out.append(f"""{tag}f AS (SELECT series, list_reduce(range(1, n_test + 1), lambda s, h: struct_pack(
                       a1 := b.phi1 * s.a1 + s.a2, a2 := b.phi2 * s.a1, x := s.x + s.a1, out := list_append(s.out, exp(s.x + s.a1))),
                     struct_pack(a1 := b.a1, a2 := b.a2, x := x_n, out := []::DOUBLE[])).out AS fc
                   FROM {px}z JOIN (SELECT series, b FROM {tag}r{spec.rounds}) USING (series))""")
    return "".join(f"\n    {x}," for x in out)


def _fit_sql(panel_cte: str, mode: str = "eval", px: str = "", models=None) -> str:
    """CTEs (prefixed by ``px``) computing the long forecast table ``{px}fc``
    of ``models`` for holdout evaluation (``eval``) or the 3-month refit
    (``final``); the same folds, grids and tie-breaks as the Spark jobs."""
    models = list(models or rules.MODEL_ORDER)
    if mode == "eval":
        frame = f"""
    {px}f0 AS (SELECT series, s, n - CAST(floor(n::DOUBLE * 0.2) AS INT) AS fit_len,
                  CAST(floor(n::DOUBLE * 0.2) AS INT) AS n_test FROM {px}arr),
    {px}f AS (SELECT series, fit_len, n_test, s[1:fit_len] AS train_s,
                 list_transform(s[1:fit_len], lambda x: x.y) AS train,
                 list_transform(s[fit_len + 1:fit_len + n_test], lambda x: x.period) AS fperiods,
                 list_transform(s[fit_len + 1:fit_len + n_test], lambda x: x.y) AS actual
          FROM {px}f0 WHERE n_test > 0 AND fit_len >= 2),"""
    else:
        frame = f"""
    {px}f0 AS (SELECT series, s, n AS fit_len, {rules.FORECAST_HORIZON} AS n_test FROM {px}arr),
    {px}f AS (SELECT series, fit_len, n_test, s[1:fit_len] AS train_s,
                 list_transform(s[1:fit_len], lambda x: x.y) AS train,
                 list_transform(range(1, n_test + 1), lambda h: CAST(s[fit_len].period + to_months(h) AS DATE))
                   AS fperiods,
                 list_transform(range(1, n_test + 1), lambda h: NULL::DOUBLE) AS actual
          FROM {px}f0 WHERE n_test > 0 AND fit_len >= 2),"""
    parts = {
        "Average": f"""SELECT series, 'Average' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             list_reduce(train, lambda a, y: a + y, 0.0::DOUBLE) / fit_len::DOUBLE AS forecast FROM {px}fh""",
        "Naive": f"""SELECT series, 'Naive' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             train[-1] AS forecast FROM {px}fh""",
        "Seasonal Naive": f"""SELECT series, 'Seasonal Naive' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             list_filter(train_s, lambda x: month(x.period) = month(fperiods[h]))[-1].y AS forecast FROM {px}fh""",
        "Drift": f"""SELECT series, 'Drift' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             train[-1] + h::DOUBLE * ((train[-1] - train[1]) / (fit_len - 1)::DOUBLE) AS forecast FROM {px}fh""",
        "SES": f"""SELECT series, 'SES' AS model, h, fperiods[h] AS period, actual[h] AS actual, {px}ses.l AS forecast
             FROM {px}fh JOIN {px}ses USING (series)""",
        "ARIMA(1,1,0)": f"""SELECT series, 'ARIMA(1,1,0)' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             {px}a110f.fc[h] AS forecast
             FROM {px}fh JOIN {px}a110f USING (series)""",
        "ARIMA(1,1,1)": f"""SELECT series, 'ARIMA(1,1,1)' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             {px}a111f.fc[h] AS forecast
             FROM {px}fh JOIN {px}a111f USING (series)""",
        "ARIMA(2,1,1)": f"""SELECT series, 'ARIMA(2,1,1)' AS model, h, fperiods[h] AS period, actual[h] AS actual,
             {px}a211f.fc[h] AS forecast
             FROM {px}fh JOIN {px}a211f USING (series)""",
    }
    ma = "".join(_arima_sql(px, m) for m in models if m in _TAGS)
    union = "\n      UNION ALL\n      ".join(parts[m] for m in models)
    return f"""
    {px}arr AS (SELECT series, list(struct_pack(period := period, y := y::DOUBLE) ORDER BY period) AS s,
                   count(*)::INT AS n FROM {panel_cte} GROUP BY 1),{frame}
    {px}fh AS (SELECT *, unnest(range(1, n_test + 1)) AS h FROM {px}f),
    {px}sesc AS (SELECT series, arg_min(k, struct_pack(sse := st.syy - st.sby * st.sby / st.sbb, alpha := alpha)) AS kc
             FROM (SELECT series, k, alpha, {_SES_FOLD} AS st
                   FROM (SELECT series, train, k, k::DOUBLE / 100.0 AS alpha FROM {px}f, range(1, 100) r(k)))
             GROUP BY 1),
    {px}ses AS (SELECT series, arg_min(st.a + st.b * (st.sby / st.sbb),
                                   struct_pack(sse := st.syy - st.sby * st.sby / st.sbb, alpha := alpha)) AS l
            FROM (SELECT series, alpha, {_SES_FOLD} AS st
                  FROM (SELECT series, train, k::DOUBLE / 1000.0 AS alpha
                        FROM {px}f JOIN {px}sesc USING (series), range(1, 1000) r(k)
                        WHERE k BETWEEN kc * 10 - 9 AND kc * 10 + 9))
            GROUP BY 1),
    {px}z AS (SELECT series, n_test, ln(train[-1]) AS x_n,
                 list_transform(range(2, fit_len + 1), lambda t: ln(train[t]) - ln(train[t - 1])) AS z
          FROM {px}f WHERE list_bool_and(list_transform(train, lambda y: y > 0))),{ma}
    {px}fc AS (
      {union})"""


def _rank_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{m}' THEN {i}" for i, m in enumerate(rules.MODEL_ORDER)) + \
        f" ELSE {len(rules.MODEL_ORDER)} END"


def _metrics_cte(px: str) -> str:
    return f"""
    {px}m AS (SELECT series, model,
                     round(list_reduce(list(abs(actual - forecast) ORDER BY h), lambda a, x: a + x, 0.0::DOUBLE)
                           / count(*)::DOUBLE, 4) AS mae,
                     round(sqrt(list_reduce(list((actual - forecast) * (actual - forecast) ORDER BY h),
                                            lambda a, x: a + x, 0.0::DOUBLE) / count(*)::DOUBLE), 4) AS rmse
              FROM {px}fc GROUP BY 1, 2 HAVING count(forecast) = count(*)),
    {px}sel AS (SELECT series, b.model AS model, b.mae AS mae, b.rmse AS rmse FROM (
                  SELECT series, arg_min(struct_pack(model := model, mae := mae, rmse := rmse),
                                         struct_pack(mae := mae, r := {_rank_sql('model')})) AS b
                  FROM {px}m GROUP BY 1))"""


def _final_sql(panel_cte: str) -> str:
    """Selected model per series (holdout) joined to the refit forecasts."""
    return f"""WITH {_chosen_ctes(panel_cte)}
    SELECT fc.series, fc.model, fc.h, fc.period, round(fc.forecast, 4) AS forecast, fc.model <> e_sel.model AS fallback
    FROM f_fc fc JOIN used USING (series, model) JOIN e_sel ON e_sel.series = fc.series"""


def _chosen_ctes(panel_cte: str) -> str:
    """Holdout metrics, refit forecasts, and per series the best scored model that the refit could fit."""
    return f"""{_fit_sql(panel_cte, 'eval', 'e_')},{_metrics_cte('e_')},{_fit_sql(panel_cte, 'final', 'f_')},
    ok AS (SELECT series, model FROM f_fc GROUP BY 1, 2 HAVING count(forecast) = count(*)),
    used AS (SELECT series, b.model AS model FROM (
               SELECT series, arg_min(struct_pack(model := model), struct_pack(mae := mae, r := {_rank_sql('model')})) AS b
               FROM e_m JOIN ok USING (series, model) GROUP BY 1))"""


BASELINE = ["Average", "Naive", "Seasonal Naive", "Drift", "SES", "ARIMA(1,1,0)"]


def _fc_sql(panel_cte: str, models=None) -> str:
    return f"""WITH {_fit_sql(panel_cte, models=models or BASELINE)}
    SELECT series, model, h, period, actual, round(forecast, 4) AS forecast FROM fc"""


def _metrics_sql(panel_cte: str, models=None) -> str:
    return f"""WITH {_fit_sql(panel_cte, models=models or BASELINE)},{_metrics_cte('')}
    SELECT * FROM m"""


def _select_sql(panel_cte: str) -> str:
    return f"""WITH {_fit_sql(panel_cte)},{_metrics_cte('')}
    SELECT * FROM sel"""


def _eval_frame(spark, sf, key=None):
    return FC.fit_frame(FC.series_arrays(regular(spark, sf, key)), "eval")


def _final(spark, sf, key=None):
    arr = FC.series_arrays(regular(spark, sf, key))
    # Metrics and refits are each read twice: fitted once, then written.
    m = write_shared(FC.row_metrics(FC.forecast_rows(FC.fit_frame(arr, "eval"))), "fit-metrics")
    fc = write_shared(FC.forecast_rows(FC.fit_frame(arr, "final")), "refits")
    return FC.final_forecast(FC.long_rows(fc), m)


@register("fc_baseline", _fc_sql("panel_all_f"), "panel_all_f")
def fc_baseline(spark, sf):
    """Holdout forecasts of the six fold-based models (O-8.7 .. O-8.12 (1,1,0))."""
    return FC.round_fc(FC.forecasts(_eval_frame(spark, sf), BASELINE))


@register("fc_baseline_metrics", _metrics_sql("panel_all_f"), "panel_all_f")
def fc_baseline_metrics(spark, sf):
    return FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf), BASELINE))


@register("fc_baseline_metrics_by_region", _metrics_sql("panel_region_f"), "panel_region_f")
def fc_baseline_metrics_by_region(spark, sf):
    return FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf, "region"), BASELINE))


@register("fc_arima_ma", _fc_sql("panel_all_f", ["ARIMA(1,1,1)", "ARIMA(2,1,1)"]), "panel_all_f")
def fc_arima_ma(spark, sf):
    """ARIMA(1,1,1) and (2,1,1) holdout forecasts (exact likelihood; NumPy, all series of a batch together)."""
    return FC.round_fc(FC.forecasts(_eval_frame(spark, sf), ["ARIMA(1,1,1)", "ARIMA(2,1,1)"]))


@register("fc_metrics", _metrics_sql("panel_all_f", rules.MODEL_ORDER), "panel_all_f")
def fc_metrics(spark, sf):
    """O-8.13 over all eight models."""
    return FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf)))


@register("fc_select", _select_sql("panel_all_f"), "panel_all_f")
def fc_select(spark, sf):
    """O-8.14: best model per series."""
    return FC.select_model(FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf))))


@register("fc_select_by_region", _select_sql("panel_region_f"), "panel_region_f")
def fc_select_by_region(spark, sf):
    return FC.select_model(FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf, "region"))))


@register("fc_final", _final_sql("panel_all_f"), "panel_all_f")
def fc_final(spark, sf):
    """O-8.15: the selected model refit on all complete months, 3 months ahead."""
    return _final(spark, sf)


def _adf_sql(panel_cte: str, log_diff: bool = False) -> str:
    """ADF by least squares in SQL: columns are made orthogonal one after the
    other (Gram-Schmidt over lists).  With the constant and the level first, the
    residual after each further lag is that lag order's; with the level last,
    its residual gives the coefficient and its standard error."""
    sub = "list_transform(range(1, len({v}) + 1), lambda i: {v}[i] - list_dot_product({v}, {q}) / list_dot_product({q}, {q}) * {q}[i])"
    from ..operators import stationarity as ST

    def poly(coef):
        return " + ".join(f"({c!r}) * power(adf_stat, {i})" for i, c in enumerate(coef))

    def crit(name):
        b = ST.ADF_CRIT[name]
        return f"{b[0]!r} + ({b[1]!r}) / nobs + ({b[2]!r}) / power(nobs, 2) + ({b[3]!r}) / power(nobs, 3)"
    src = (f"""x0 AS (SELECT series, list(y::DOUBLE ORDER BY period) AS ys, bool_and(y > 0) AS ok FROM {panel_cte} GROUP BY 1),
    x AS (SELECT series, list_transform(range(2, len(ys) + 1), lambda t: ln(ys[t]) - ln(ys[t - 1])) AS x FROM x0 WHERE ok),"""
           if log_diff else f"x AS (SELECT series, list(y::DOUBLE ORDER BY period) AS x FROM {panel_cte} GROUP BY 1),")
    return f"""
    SELECT * FROM (WITH RECURSIVE {src}
    d AS (SELECT series, x, list_transform(range(1, len(x)), lambda t: x[t + 1] - x[t]) AS dx,
                 least(len(x) // 2 - 2, CAST(ceil(12.0 * power(len(x) / 100.0, 0.25)) AS BIGINT)) AS m FROM x WHERE len(x) >= 6),
    -- Common sample of the search: rows m+1 .. len(dx); columns 1, level, lag 1 .. m.
    s0 AS (SELECT series, m, len(dx) - m AS n, dx[m + 1:] AS y,
                  list_concat([list_transform(dx[m + 1:], lambda v: 1.0::DOUBLE), x[m + 1:len(dx)]],
                              list_transform(range(1, m + 1), lambda k: dx[m + 1 - k:len(dx) - k])) AS cols FROM d),
    g AS (SELECT series, m, n, cols, y, 0 AS i, []::DOUBLE[][] AS q, NULL::DOUBLE AS ssr FROM s0
          UNION ALL
          SELECT series, m, n, cols, {sub.format(v='y', q='v')}, i + 1, list_append(q, v), NULL
          FROM (SELECT series, m, n, cols, y, i, q, list_reduce(q, lambda a, b: {sub.format(v='a', q='b')}, cols[i + 1]) AS v
                FROM g WHERE i < len(cols))),
    aic AS (SELECT series, i - 2 AS lags, n * (ln(2 * pi()) + ln(list_dot_product(y, y) / n) + 1.0) + 2.0 * i AS aic FROM g WHERE i >= 2),
    best AS (SELECT series, arg_min(lags, struct_pack(a := aic, l := lags)) AS lags FROM aic GROUP BY 1),
    -- All rows of the chosen order: columns 1, lags, and the level last.
    f0 AS (SELECT series, lags, len(dx) - lags AS n, dx[lags + 1:] AS y,
                  list_concat(list_concat([list_transform(dx[lags + 1:], lambda v: 1.0::DOUBLE)],
                                          list_transform(range(1, lags + 1), lambda k: dx[lags + 1 - k:len(dx) - k])),
                              [x[lags + 1:len(dx)]]) AS cols FROM d JOIN best USING (series)),
    f AS (SELECT series, lags, n, cols, y, y AS y1, []::DOUBLE[] AS v1, 0 AS i, []::DOUBLE[][] AS q FROM f0
          UNION ALL
          SELECT series, lags, n, cols, {sub.format(v='y', q='v')}, y, v, i + 1, list_append(q, v)
          FROM (SELECT series, lags, n, cols, y, i, q, list_reduce(q, lambda a, b: {sub.format(v='a', q='b')}, cols[i + 1]) AS v
                FROM f WHERE i < len(cols))),
    r AS (SELECT series, lags AS used_lag, n AS nobs,
                 list_dot_product(y1, v1) / list_dot_product(v1, v1)
                 / sqrt(list_dot_product(y, y) / (n - len(cols)) / list_dot_product(v1, v1)) AS adf_stat FROM f WHERE i = len(cols))
    SELECT series, round(adf_stat, 6) AS adf_stat, used_lag, nobs,
           CASE WHEN adf_stat > {ST.ADF_TAU_MAX} THEN 'none' WHEN adf_stat <= {crit('1%')} THEN '1%'
                WHEN adf_stat <= {crit('5%')} THEN '5%' WHEN adf_stat <= {crit('10%')} THEN '10%' ELSE 'none' END AS rejected_at,
           round({crit('1%')}, 6) AS crit_1pct, round({crit('5%')}, 6) AS crit_5pct, round({crit('10%')}, 6) AS crit_10pct,
           round(CASE WHEN adf_stat <= {ST.ADF_TAU_STAR} THEN {poly(ST.ADF_SMALL_P)} ELSE {poly(ST.ADF_LARGE_P)} END, 6) AS p_score
    FROM r) z"""


def _adf(spark, sf, key=None, log_diff=False):
    """ADF statistic, order and critical values, with the score whose normal
    probability is the p-value (SQL has no error function)."""
    from ..operators import stationarity as ST
    a = ST.adf_panel(FC.series_arrays(regular(spark, sf, key)), log_diff=log_diff).filter(F.col("reason").isNull())
    stat = F.col("adf_stat")

    def poly(coef):
        return sum((F.lit(c) * F.pow(stat, F.lit(float(i))) for i, c in enumerate(coef[1:], start=1)), F.lit(coef[0]))
    at = F.when(stat > ST.ADF_TAU_MAX, "none")
    for name, col in (("1%", "crit_1pct"), ("5%", "crit_5pct"), ("10%", "crit_10pct")):
        at = at.when(stat <= F.col(col), name)
    score = F.when(stat <= ST.ADF_TAU_STAR, poly(ST.ADF_SMALL_P)).otherwise(poly(ST.ADF_LARGE_P))
    return a.select("series", round_dp(stat, 6).alias("adf_stat"), F.col("used_lag").cast("bigint").alias("used_lag"),
                    F.col("nobs").cast("bigint").alias("nobs"), at.otherwise("none").alias("rejected_at"),
                    *[round_dp(c, 6).alias(c) for c in ("crit_1pct", "crit_5pct", "crit_10pct")], round_dp(score, 6).alias("p_score"))


@register("adf", _adf_sql("panel_all_f"), "panel_all_f")
def adf(spark, sf):
    """O-8.3 on the monthly series."""
    return _adf(spark, sf)


@register("adf_log_diff", _adf_sql("panel_all_f", True), "panel_all_f")
def adf_log_diff(spark, sf):
    return _adf(spark, sf, log_diff=True)


@register("adf_by_region", _adf_sql("panel_region_f"), "panel_region_f")
def adf_by_region(spark, sf):
    return _adf(spark, sf, "region")


def _pacf_sql(panel_cte: str, max_lag: int = 20) -> str:
    acf_src = _acf_sql(panel_cte)
    raw = acf_src[:acf_src.index("    cu AS (")].rstrip().rstrip(",")
    num = "(r[k + 1] - list_reduce(range(1, k), lambda a, j: a + s.phi[j] * r[k - j + 1], 0.0::DOUBLE))"
    den = "(1.0 - list_reduce(range(1, k), lambda a, j: a + s.phi[j] * r[j + 1], 0.0::DOUBLE))"
    kk = f"({num} / {den})"
    return f"""{raw},
    rl AS (SELECT series, list(r ORDER BY k) AS r, max(n) AS n, max(k) AS kmax FROM r GROUP BY 1),
    lim AS (SELECT series, r, least({max_lag}, n // 2 - 1, kmax) AS kk FROM rl),
    ld AS (SELECT series, list_reduce(range(1, kk + 1), lambda s, k: struct_pack(
               phi := list_concat(list_transform(range(1, k), lambda j: s.phi[j] - {kk} * s.phi[k - j]), [{kk}]),
               pacf := list_append(s.pacf, {kk})),
             struct_pack(phi := []::DOUBLE[], pacf := [1.0::DOUBLE])).pacf AS p FROM lim)
    SELECT series, (i - 1)::BIGINT AS k, round(p[i], 9) AS pacf FROM ld, range(1, len(p) + 1) t(i)"""


@register("pacf", _pacf_sql("panel_all_c"), "panel_all_c")
def pacf(spark, sf):
    """O-8.5: Yule-Walker PACF (Levinson-Durbin over the ACF, lags < n/2)."""
    from ..operators import stationarity as ST
    out = ST.pacf(TS.acf_raw(panel(spark, sf), 24), 20)
    return out.select("series", F.col("k").cast("bigint").alias("k"), round_dp("pacf", 9).alias("pacf"))


@register("monthly_revenue_by_category", """
    SELECT series, period, y::DOUBLE AS revenue, orders FROM panel_category_c""", "panel_category_c")
def monthly_revenue_by_category(spark, sf):
    return category_panel(spark, sf).select("series", "period", F.col("y").cast("double").alias("revenue"), "orders")


@register("fc_baseline_metrics_by_category", _metrics_sql("panel_category_f"), "panel_category_f")
def fc_baseline_metrics_by_category(spark, sf):
    """Declared product forecast, per category: holdout metrics of the fold models."""
    return FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf, "category"), BASELINE))


@register("fc_final_by_category", _final_sql("panel_category_f"), "panel_category_f")
def fc_final_by_category(spark, sf):
    """Declared 3-month product forecast, per category, with model selection."""
    return _final(spark, sf, "category")


@register("pacf_by_region", _pacf_sql("panel_region_f"), "panel_region_f")
def pacf_by_region(spark, sf):
    from ..operators import stationarity as ST
    out = ST.pacf(TS.acf_raw(regular(spark, sf, "region"), 24), 20)
    return out.select("series", F.col("k").cast("bigint").alias("k"), round_dp("pacf", 9).alias("pacf"))


@register("fc_baseline_metrics_by_product", _metrics_sql("panel_product_f"), "panel_product_f")
def fc_baseline_metrics_by_product(spark, sf):
    """Declared product forecast: holdout metrics per product (fold models)."""
    return FC.row_metrics(FC.forecast_rows(_eval_frame(spark, sf, "sku"), BASELINE))


@register("fc_final_by_product", _final_sql("panel_product_f"), "panel_product_f")
def fc_final_by_product(spark, sf):
    """Declared 3-month forecast per product (sku), after the last complete
    month, with model selection over all eight models; ``fc_exclusions_by_product``
    says which models could not take part."""
    return _final(spark, sf, "sku")


def _exclusions_sql(panel_cte: str) -> str:
    arima = "('ARIMA(1,1,0)', 'ARIMA(1,1,1)', 'ARIMA(2,1,1)')"
    return f"""
    WITH s AS (SELECT series, count(*) AS n, bool_and(y > 0) AS positive, count(DISTINCT y) AS kinds FROM {panel_cte} GROUP BY 1)
    SELECT series, model, CASE WHEN n < 5 THEN 'fewer than 5 months'
                               WHEN model = 'Seasonal Naive' THEN 'a month without an earlier one of its name'
                               WHEN NOT positive THEN 'a month is not positive' ELSE 'constant' END AS reason
    FROM s, (SELECT unnest([{", ".join("'" + m + "'" for m in rules.MODEL_ORDER)}]) AS model)
    WHERE n < 5 OR (model = 'Seasonal Naive' AND n - CAST(floor(n * 0.2) AS INT) < 12)
       OR (model IN {arima} AND (NOT positive OR kinds = 1))"""


@register("fc_exclusions_by_product", _exclusions_sql("panel_product_f"), "panel_product_f")
def fc_exclusions_by_product(spark, sf):
    """Per product: the models that cannot be scored or refit, and why."""
    return FC.exclusions(FC.series_arrays(regular(spark, sf, "sku")))


@register("fc_exclusions_by_region", _exclusions_sql("panel_region_f"), "panel_region_f")
def fc_exclusions_by_region(spark, sf):
    return FC.exclusions(FC.series_arrays(regular(spark, sf, "region")))


@register("series_exclusions_by_region", """
    WITH s AS (SELECT series, count(*) AS n, bool_and(y > 0) AS positive FROM panel_region_f GROUP BY 1)
    SELECT series, analysis, reason FROM (
      SELECT series, 'decomposition' AS analysis, 'fewer than 24 months' AS reason, n < 24 AS out FROM s
      UNION ALL SELECT series, 'logarithm', 'a month is not positive', NOT positive FROM s
      UNION ALL SELECT series, 'stationarity', 'fewer than 6 months', n < 6 FROM s) WHERE out""", "panel_region_f")
def series_exclusions_by_region(spark, sf):
    """Series that an analysis leaves out, and why."""
    return TS.exclusions(regular(spark, sf, "region"))
