"""Panel time series: monthly buckets, trends, growth, decomposition, ACF
(O-6.18, O-7.5 .. O-7.11, O-8.1, O-8.2, O-8.4, O-8.6, O-8.16, O-12.2).

A panel is a long table ``(series, period, y)``; the source's single global
series is ``series = 'all'``.  After the monthly aggregation a panel holds one
row per series and month, so windows partitioned by ``series`` and one array
per series are bounded by the number of months, not by the input size.
Money stays decimal until the last step so window sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from ..functions import cleaning as C
from ..functions import rules
from .regions import complete_month_cutoff


def series_key(col: str | None) -> Column:
    return F.lit("all") if col is None else F.col(col).cast("string")


def monthly_panel(orders: DataFrame, key: str | None = None, value: str = "order_total_amount") -> DataFrame:
    """O-6.18: revenue (exact decimal) and orders per series and month;
    months without orders are absent (as in the source)."""
    return (orders.filter(F.col("order_date").isNotNull())
            .groupBy(series_key(key).alias("series"), C.month_start("order_date").alias("period"))
            .agg(F.sum(value).alias("y"), F.count("*").alias("orders")))


def complete_months(panel: DataFrame, orders: DataFrame) -> DataFrame:
    """O-4.5 / O-8.16: drop months after the last complete month of the data."""
    cutoff = complete_month_cutoff(orders.agg(F.max("order_date")).scalar())
    return panel.filter(F.col("period") <= cutoff)


def fill_gaps(panel: DataFrame, until: Column | None = None) -> DataFrame:
    """Zero-fill of missing months from each series' first month to ``until``
    (the last complete month of the data; default: the series' last month), by
    ``sequence`` + ``explode`` of one row per series.  Seasons, lags and
    month-on-month growth need it: they count rows as months (SURVEY §7.9).
    A filled month has revenue 0, so its logarithm is undefined."""
    last = F.max("period") if until is None else until
    bounds = panel.groupBy("series").agg(F.min("period").alias("a"), last.alias("b"))
    grid = bounds.select("series", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("period"))
    return (grid.join(panel, ["series", "period"], "left")
            .withColumn("y", F.coalesce(F.col("y"), F.lit(0).cast(panel.schema["y"].dataType)))
            .withColumn("orders", F.coalesce(F.col("orders"), F.lit(0))))


def validate_range(orders: DataFrame, start: str, end: str) -> None:
    """O-4.9 checks before the job: start <= end and both inside the
    available range (one 1-row aggregate reaches the driver)."""
    import datetime as dt
    s, e = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if s > e:
        raise ValueError(f"start {s} after end {e}")
    lo, hi = orders.agg(F.min("order_date").cast("date"), F.max("order_date").cast("date")).first()
    if lo is None or s < lo or e > hi:
        raise ValueError(f"range {s}..{e} outside available {lo}..{hi}")


def partial_months(panel_all: DataFrame, orders: DataFrame) -> DataFrame:
    """O-8.16 report: the months excluded as incomplete."""
    cutoff = complete_month_cutoff(orders.agg(F.max("order_date")).scalar())
    return panel_all.filter(F.col("period") > cutoff).select(
        "series", "period", F.col("y").cast("double").alias("revenue"), "orders")


def revenue_trend(orders: DataFrame, granularity: str = "monthly", start=None, end=None) -> DataFrame:
    """O-12.2 (+ O-4.9): revenue and orders per day / ISO week (Monday) /
    month, with ``is_partial`` when the period ends after the last order of the
    whole data (a range narrows the periods, not what is known)."""
    d = F.col("order_date").cast("date")
    periods = {"daily": d, "weekly": F.date_trunc("week", F.col("order_date")).cast("date"),
               "monthly": F.trunc(d, "MM")}
    if granularity not in periods:
        raise ValueError(f"granularity {granularity!r}")
    period = periods[granularity]
    through = orders.agg(F.max("order_date")).scalar().cast("date")
    o = orders
    if start is not None:
        o = o.filter(d >= F.lit(start).cast("date"))
    if end is not None:
        o = o.filter(d <= F.lit(end).cast("date"))
    g = o.groupBy(period.alias("period")).agg(F.sum("order_total_amount").cast("double").alias("revenue"),
                                              F.count("*").alias("orders"))
    pend = {"daily": F.col("period"), "weekly": F.date_add("period", 6),
            "monthly": F.last_day("period")}[granularity]
    return g.withColumn("is_partial", pend > through)


def _w(order: str = "period") -> Window:
    return Window.partitionBy("series").orderBy(order)


def growth(panel: DataFrame) -> DataFrame:
    """O-7.5: month-on-month growth (%) per series, null when previous is 0/absent."""
    prev = F.lag("y").over(_w())
    return panel.select("series", "period", F.col("y").cast("double").alias("y"),
                        C.growth_pct(F.col("y"), prev).alias("growth_pct"))


def log_diff(panel: DataFrame) -> DataFrame:
    """O-8.2 / O-7.6 / O-3.23: ln(y) and its first difference per series (y <= 0 -> null)."""
    ly = F.when(F.col("y") > 0, F.log(F.col("y").cast("double")))
    p = panel.select("series", "period", ly.alias("_l"))
    # 9 decimals: logs from different math libraries may differ in the last ulp
    return p.select("series", "period", round_dp("_l", 9).alias("log_y"),
                    round_dp(F.col("_l") - F.lag("_l").over(_w()), 9).alias("diff_log_y"))


def indexed(panel: DataFrame) -> DataFrame:
    """O-7.9: 1-based step index and series length."""
    return (panel.withColumn("i", F.row_number().over(_w()))
            .withColumn("n", F.count("*").over(Window.partitionBy("series"))))


def decompose(panel: DataFrame, model: str = "additive", period: int = rules.SEASON_LENGTH) -> DataFrame:
    """O-8.1: classical decomposition with a centered 2x``period`` moving
    average (O-7.11); seasonal means by position, centered (additive: minus
    the mean; multiplicative: divided by the mean).  Series shorter than
    2 * period are skipped."""
    half = period // 2
    p = indexed(panel).filter(F.col("n") >= 2 * period)
    w = _w("i")
    inner = F.sum("y").over(w.rowsBetween(-(half - 1), half - 1))
    num = F.lag("y", half).over(w) + 2 * inner + F.lead("y", half).over(w)
    trend = num.cast("double") / float(2 * period)
    p = p.withColumn("trend", trend).withColumn("pos", F.pmod(F.col("i") - 1, F.lit(period)))
    yd = F.col("y").cast("double")
    detr = yd - F.col("trend") if model == "additive" else yd / F.col("trend")
    p = p.withColumn("_d", detr)
    # Means are sequential folds over index-sorted values, so the result does
    # not depend on partitioning (bit-identical across runs and engines).
    pos_mean = (p.filter(F.col("_d").isNotNull()).groupBy("series", "pos")
                .agg(_ordered_mean(F.col("i"), F.col("_d")).alias("_s")))
    norm = pos_mean.groupBy("series").agg(_ordered_mean(F.col("pos"), F.col("_s")).alias("_m"))
    s = pos_mean.join(norm, "series").select(
        "series", "pos",
        (F.col("_s") - F.col("_m") if model == "additive" else F.col("_s") / F.col("_m")).alias("seasonal"))
    out = p.join(s, ["series", "pos"])
    resid = (yd - F.col("trend") - F.col("seasonal")) if model == "additive" \
        else yd / (F.col("trend") * F.col("seasonal"))
    return out.select("series", "period", yd.alias("y"), "trend", "seasonal", resid.alias("resid"))


def _ordered_mean(order: Column, value: Column) -> Column:
    """Mean as a fold over values sorted by ``order`` (group size is bounded
    by the series length)."""
    arr = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size(arr).cast("double")


def exclusions(panel: DataFrame, period: int = rules.SEASON_LENGTH) -> DataFrame:
    """One row per series and analysis that leaves it out, with the reason."""
    s = panel.groupBy("series").agg(F.count("*").alias("n"), F.bool_and(F.col("y") > 0).alias("positive"))
    checks = [("decomposition", f"fewer than {2 * period} months", F.col("n") < 2 * period),
              ("logarithm", "a month is not positive", ~F.col("positive")), ("stationarity", "fewer than 6 months", F.col("n") < 6)]
    rows = F.filter(F.array(*[F.when(out, F.struct(F.lit(a).alias("analysis"), F.lit(r).alias("reason"))) for a, r, out in checks]),
                    lambda x: x.isNotNull())
    return s.select("series", F.explode(rows).alias("x")).select("series", "x.analysis", "x.reason")


def acf(panel: DataFrame, max_lag: int = rules.ACF_LAGS) -> DataFrame:
    """O-8.4: biased autocorrelation r_k for k = 0..max_lag (k < n) and the
    Bartlett 95 % band, per series."""
    r = acf_raw(panel, max_lag)
    cum = F.sum(F.when(F.col("k") > 0, F.col("r") * F.col("r")).otherwise(0.0)).over(
        Window.partitionBy("series").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    band = F.lit(1.96) * F.sqrt((F.lit(1.0) + 2.0 * F.coalesce(cum, F.lit(0.0))) / F.col("n").cast("double"))
    return r.select("series", F.col("k").cast("bigint").alias("k"), round_dp("r", 9).alias("acf"),
                    round_dp(F.when(F.col("k") > 0, band), 9).alias("band"))


def acf_raw(panel: DataFrame, max_lag: int = rules.ACF_LAGS) -> DataFrame:
    """(series, k, n, r) unrounded.  Each row meets at most ``max_lag + 1``
    lagged partners (an equi-join on (series, i - k)), never all pairs."""
    p = indexed(panel)
    stats = p.groupBy("series").agg((F.sum("y").cast("double") / F.count("y").cast("double")).alias("_m"),
                                    F.count("y").alias("n"))
    d = p.join(stats.drop("n"), "series").select("series", "i", (F.col("y").cast("double") - F.col("_m")).alias("d"))
    lags = d.select("series", F.col("i").alias("i"), F.col("d").alias("d0"),
                    F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("k"))
    other = d.select("series", F.col("i").alias("j"), F.col("d").alias("dk"))
    pairs = lags.join(other, (lags.series == other.series) & (other.j == lags.i - lags.k)).drop(other.series)
    num = pairs.groupBy("series", "k").agg(F.sum(F.col("d0") * F.col("dk")).alias("_c"))
    den = num.filter("k = 0").select("series", F.col("_c").alias("_c0"))
    r = num.join(den, "series").join(stats.select("series", "n"), "series") \
        .filter(F.col("k") < F.col("n")) \
        .select("series", "k", "n", (F.col("_c") / F.col("_c0")).alias("r"))
    return r
