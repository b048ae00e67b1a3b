"""Panel forecasting: eight models per series, holdout metrics, selection and
the final 3-month forecast (O-8.6 .. O-8.15).

Every series is one row holding its (bounded, one value per month) history
as an array.  The simple models are array expressions; SES and ARIMA run in
NumPy (series of one length and all grid points together) inside
``mapInPandas``.  Folds are
sequential, so sums do not depend on partitioning.

Deviations from the source's library fits, by design (SURVEY §7.9):
SES searches alpha on a 0.01 grid refined to 0.001 (the initial level is
estimated exactly for every alpha).  ARIMA maximizes the exact likelihood
(Kalman filter) on a grid refined to steps under 1e-4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import round_dp

from ..functions import rules
from . import arima as AR

DOUBLE_ARRAY = "array<double>"


def series_arrays(panel: DataFrame) -> DataFrame:
    """(series, period, y) -> one row per series: periods, ys (double), n."""
    s = (panel.groupBy("series")
         .agg(F.array_sort(F.collect_list(F.struct("period", F.col("y").cast("double").alias("y")))).alias("_s")))
    return s.select("series", "_s", F.transform("_s", lambda x: x["period"]).alias("periods"),
                    F.transform("_s", lambda x: x["y"]).alias("ys"), F.size("_s").alias("n"))


def fit_frame(arrays: DataFrame, mode: str = "eval", horizon: int = rules.FORECAST_HORIZON) -> DataFrame:
    """Training window and forecast horizon per series.

    eval:  the last floor(0.2 n) months are the test set (O-8.6).
    final: all months, forecast ``horizon`` months after the last (O-8.15)."""
    n = F.col("n")
    if mode == "eval":
        test = F.floor(n.cast("double") * rules.TEST_SHARE).cast("int")
        a = arrays.withColumn("fit_len", n - test).withColumn("H", test)
        a = a.withColumn("fperiods", F.slice("periods", F.col("fit_len") + 1, F.col("H")))
        a = a.withColumn("actual", F.slice("ys", F.col("fit_len") + 1, F.col("H")))
    else:
        a = arrays.withColumn("fit_len", n).withColumn("H", F.lit(horizon))
        last = F.element_at("periods", -1)
        a = a.withColumn("fperiods", F.transform(F.sequence(F.lit(1), F.col("H")), lambda h: F.add_months(last, h)))
        a = a.withColumn("actual", F.array_repeat(F.lit(None).cast("double"), F.col("H")))
    a = a.filter((F.col("H") > 0) & (F.col("fit_len") >= 2))
    a = a.withColumn("train", F.slice("ys", 1, F.col("fit_len"))) \
         .withColumn("train_s", F.slice("_s", 1, F.col("fit_len")))
    return a.select("series", "fit_len", "H", "fperiods", "actual", "train", "train_s")


def _fold_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, y: acc + y)


def fc_average() -> Column:
    """O-8.7: training mean."""
    return F.array_repeat(_fold_sum(F.col("train")) / F.col("fit_len").cast("double"), F.col("H"))


def fc_naive() -> Column:
    """O-8.8: last training value."""
    return F.array_repeat(F.element_at("train", -1), F.col("H"))


def fc_seasonal_naive() -> Column:
    """O-8.9 / O-7.8: last training value of the same calendar month; a month
    never seen in training gives null (the model is then not scored)."""
    return F.transform("fperiods", lambda p: F.try_element_at(
        F.filter("train_s", lambda s: F.month(s["period"]) == F.month(p)), F.lit(-1))["y"])


def fc_drift() -> Column:
    """O-8.10: y_n + h * ((y_n - y_1) / (n - 1))."""
    yn, y1 = F.element_at("train", -1), F.element_at("train", 1)
    slope = (yn - y1) / (F.col("fit_len") - 1).cast("double")
    return F.transform(F.sequence(F.lit(1), F.col("H")), lambda h: yn + h.cast("double") * slope)


SES_POINTS = 16_384  # series x alphas advanced at once


def ses_levels(series) -> list[float]:
    """Final level of the best SES fit of each series (NumPy, series of one length
    and all alphas together): alpha on a 0.01 grid, then 0.001 steps around the
    best; smallest SSE wins, smaller alpha on ties."""
    import numpy as np

    def grid(y, ks, div):
        """``ks``: (series or 1, alphas), ascending -> best k and level of each series."""
        alpha = ks / div
        rest = 1.0 - alpha
        a, b = np.zeros((len(y), ks.shape[1])), np.ones(ks.shape)
        syy, sby, sbb = np.zeros(a.shape), np.zeros(a.shape), np.zeros(ks.shape)
        for t in range(y.shape[1]):
            x = y[:, t][:, None]
            d = x - a
            syy += d * d
            sby += b * d
            sbb += b * b
            a = alpha * x + rest * a
            b = rest * b
        i = np.argmin(syy - sby * sby / sbb, axis=1)  # the first of equal ones has the smallest alpha
        rows = np.arange(len(y))
        return np.broadcast_to(ks, a.shape)[rows, i], (a + b * (sby / sbb))[rows, i]

    out: list[float] = [0.0] * len(series)
    by_length: dict[int, list[int]] = {}
    for i, ys in enumerate(series):
        by_length.setdefault(len(ys), []).append(i)
    coarse, around = np.arange(1, 100)[None], np.arange(-9, 10)  # 10 k - 9 to 10 k + 9 are within 1 to 999
    step = max(1, SES_POINTS // coarse.shape[1])
    for ids in by_length.values():
        for at in range(0, len(ids), step):
            some = ids[at:at + step]
            y = np.array([series[i] for i in some], float).reshape(len(some), -1)
            k, _ = grid(y, coarse, 100.0)
            _, level = grid(y, k[:, None] * 10 + around, 1000.0)
            for i, x in zip(some, level):
                out[i] = float(x)
    return out


def ses_search(ys) -> float:
    """:func:`ses_levels` of one series."""
    return ses_levels([list(ys)])[0]


# ------------------------------------------------------------------ ARIMA(p,1,q) by exact likelihood

def _numpy_fits(names: list[str], horizons, trains) -> list[tuple[int, str, list[float]]]:
    """(row, model, forecasts) of every series that a model can be fitted to."""
    import math

    import numpy as np
    out, fits = [], []  # fits: (row, horizon, last log, differences)
    trains = [[float(v) for v in train] for train in trains]
    if "SES" in names:
        out += [(i, "SES", [x] * int(horizons[i])) for i, x in enumerate(ses_levels(trains))]
    for i, y in enumerate(trains):
        if len(y) < 2 or not all(v > 0 for v in y):
            continue
        # scalar C-library log per value (same rounding as SQL engines)
        x = np.array([math.log(v) for v in y])
        fits.append((i, int(horizons[i]), float(x[-1]), np.array([x[t] - x[t - 1] for t in range(1, len(x))])))
    for name in names:
        if name not in AR.SPECS or not fits:
            continue
        for (i, h, last, _z), got in zip(fits, AR.fit([f[3] for f in fits], name)):
            if got is not None:
                phi1, phi2, _theta, a1, a2, _obj = got
                out.append((i, name, AR.forecast(last, phi1, phi2, a1, a2, h)))
    return out


def fc_numpy(f: DataFrame, names) -> DataFrame:
    """SES and the ARIMA models (exact likelihood, :mod:`.arima`); all series of an Arrow batch are fitted together.
    Periods and actual values go along, so that forecasts need not be joined to them."""
    names = list(names)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            got = _numpy_fits(names, b.column(1).to_pylist(), b.column(2).to_pylist())
            row = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.float64())),
                 b.column(3).take(row), b.column(4).take(row)], ["series", "model", "fc", "fperiods", "actual"])

    return f.select("series", "H", "train", "fperiods", "actual").mapInArrow(
        run, "series string, model string, fc array<double>, fperiods array<date>, actual array<double>")


#: Models that are expressions over a series' row; the others are fitted in NumPy (O-8.11, O-8.12).
SIMPLE = {"Average": fc_average, "Naive": fc_naive, "Seasonal Naive": fc_seasonal_naive, "Drift": fc_drift}
BASELINE_MODELS = ["Average", "Naive", "Seasonal Naive", "Drift", "SES"]


def forecast_rows(f: DataFrame, models=None) -> DataFrame:
    """One row (series, model, fc, fperiods, actual) for each series and model; the
    arrays are parallel, in order of the horizon.  Series without a name are left out."""
    names = list(models or rules.MODEL_ORDER)
    f = f.filter(F.col("series").isNotNull())
    simple = [F.struct(F.lit(n).alias("model"), SIMPLE[n]().alias("fc")) for n in names if n in SIMPLE]
    grid = [n for n in names if n not in SIMPLE]
    parts = []
    if simple:
        parts.append(f.select("series", "fperiods", "actual", F.explode(F.array(*simple)).alias("x"))
                     .select("series", "x.model", "x.fc", "fperiods", "actual"))
    if grid:
        parts.append(fc_numpy(f, grid))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def long_rows(rows: DataFrame) -> DataFrame:
    """:func:`forecast_rows` -> long table (series, model, h, period, actual, forecast)."""
    return rows.select("series", "model", F.posexplode(F.arrays_zip(
        F.col("fperiods").alias("period"), F.col("actual").alias("actual"), F.col("fc").alias("forecast"))
    ).alias("pos", "v")).select("series", "model", (F.col("pos") + 1).cast("bigint").alias("h"), "v.period", "v.actual",
                                "v.forecast")


def forecasts(f: DataFrame, models=None) -> DataFrame:
    """Long table (series, model, h, period, actual, forecast)."""
    return long_rows(forecast_rows(f, models))


def metrics(fc: DataFrame) -> DataFrame:
    """O-8.13: MAE and RMSE per (series, model); models with a missing
    forecast in the horizon are not scored."""
    e = F.col("actual") - F.col("forecast")
    # Sums are folds over the horizon-sorted errors (bounded by the test
    # length), so the metrics do not depend on partitioning and round the same
    # way everywhere.
    errs = F.array_sort(F.collect_list(F.struct(F.col("h"), F.abs(e).alias("ae"), (e * e).alias("se"))))
    m = fc.groupBy("series", "model").agg(errs.alias("_e"), F.count("forecast").alias("_k"),
                                          F.count("*").alias("_n"))
    n = F.col("_n").cast("double")
    mae = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x["ae"]) / n
    rmse = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x["se"]) / n)
    return m.filter(F.col("_k") == F.col("_n")).select(
        "series", "model", round_dp(mae, 4).alias("mae"), round_dp(rmse, 4).alias("rmse"))


def row_metrics(rows: DataFrame) -> DataFrame:
    """:func:`metrics` of :func:`forecast_rows`: the same folds, without a shuffle."""
    errors = F.transform(F.arrays_zip(F.col("actual").alias("a"), F.col("fc").alias("f")), lambda x: x["a"] - x["f"])
    m = rows.filter(F.forall("fc", lambda x: x.isNotNull())).withColumn("_e", errors)
    n = F.size("_e").cast("double")
    mae = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + F.abs(e)) / n
    rmse = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e * e) / n)
    return m.select("series", "model", round_dp(mae, 4).alias("mae"), round_dp(rmse, 4).alias("rmse"))


def model_rank(name: Column) -> Column:
    out = None
    for i, m in enumerate(rules.MODEL_ORDER):
        out = F.when(name == m, i) if out is None else out.when(name == m, i)
    return out.otherwise(len(rules.MODEL_ORDER))


def select_model(m: DataFrame) -> DataFrame:
    """O-8.14: smallest MAE per series, ties by the fixed model order (a
    ``min_by`` per series, no window)."""
    return m.groupBy("series").agg(F.min_by(F.struct("model", "mae", "rmse"),
                                            F.struct(F.col("mae"), model_rank(F.col("model")))).alias("b")) \
        .select("series", "b.model", "b.mae", "b.rmse")


def usable(m: DataFrame, final_fc: DataFrame) -> DataFrame:
    """The best scored model of each series that the refit could fit too."""
    ok = (final_fc.groupBy("series", "model").agg((F.count("forecast") == F.count("*")).alias("_ok")).filter("_ok"))
    return select_model(m.join(ok, ["series", "model"], "left_semi"))


def final_forecast(final_fc: DataFrame, m: DataFrame) -> DataFrame:
    """O-8.15: the selected model's forecast, refit on all complete months.  If
    the best model by holdout metrics ``m`` cannot be refit (a later month is
    not positive, say), the next scored one is used and ``fallback`` is true."""
    best = select_model(m).select("series", F.col("model").alias("_best"))
    return (final_fc.join(usable(m, final_fc).select("series", "model"), ["series", "model"]).join(best, "series")
            .select("series", "model", "h", "period", round_dp("forecast", 4).alias("forecast"),
                    (F.col("model") != F.col("_best")).alias("fallback")))


def exclusions(arrays: DataFrame) -> DataFrame:
    """One row per series and model that cannot be scored or refit, with the reason."""
    model = F.col("model")
    test = F.floor(F.col("n").cast("double") * rules.TEST_SHARE).cast("int")
    arima = model.startswith("ARIMA")
    reason = (F.when(F.col("n") < 5, "fewer than 5 months")
              .when((model == "Seasonal Naive") & (F.col("n") - test < rules.SEASON_LENGTH), "a month without an earlier one of its name")
              .when(arima & F.exists("ys", lambda y: y <= 0), "a month is not positive")
              .when(arima & (F.size(F.array_distinct("ys")) == 1), "constant"))
    return (arrays.select("series", "n", "ys", F.explode(F.array(*[F.lit(m) for m in rules.MODEL_ORDER])).alias("model"))
            .select("series", "model", reason.alias("reason")).filter("reason IS NOT NULL"))


def round_fc(fc: DataFrame) -> DataFrame:
    return fc.withColumn("forecast", round_dp("forecast", 4))

