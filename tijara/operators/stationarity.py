"""Stationarity test and partial autocorrelation per series (O-8.3, O-8.5).

Both are small per-series linear-algebra problems (one value per month), so
they run as NumPy inside ``mapInPandas`` / ``applyInPandas`` over the
one-row-per-series (or one-row-per-lag) frames; Spark distributes series.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: MacKinnon (1994) response surface for the p-value of the
# Dickey-Fuller t statistic, regression with constant, one variable.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
# FIXED VALUES: MacKinnon (2010) critical values, constant, one variable:
# crit = b0 + b1/n + b2/n^2 + b3/n^3 for 1 %, 5 %, 10 %.
ADF_CRIT = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
            "5%": [-2.86154, -2.8903, -4.234, -40.040],
            "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL_P if stat <= ADF_TAU_STAR else ADF_LARGE_P
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def adf_crit(nobs: int) -> dict[str, float]:
    return {k: b[0] + b[1] / nobs + b[2] / nobs ** 2 + b[3] / nobs ** 3 for k, b in ADF_CRIT.items()}


def _ols(y, X):
    import numpy as np
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    ssr = float(resid @ resid)
    return beta, ssr


def _design(x, lags: int, max_lag: int | None = None):
    """Rows t usable with ``max_lag`` lags (common sample), regressors
    [x_{t-1}, dx_{t-1}..dx_{t-lags}, 1] and target dx_t."""
    import numpy as np
    dx = np.diff(x)
    m = lags if max_lag is None else max_lag
    nobs = len(dx) - m
    cols = [x[m:m + nobs]]  # x_{t-1} aligned with dx_t = dx[m + j]
    for k in range(1, lags + 1):
        cols.append(dx[m - k:m - k + nobs])
    cols.append(np.ones(nobs))
    return dx[m:], np.column_stack(cols), nobs


def adf(x, max_lag: int | None = None) -> dict:
    """Augmented Dickey-Fuller with constant; lag order by AIC on a common
    sample, then refit on all usable rows.  A series without a statistic (too
    short, or fitted without residual) has only a ``reason``."""
    import numpy as np
    x = np.asarray(x, dtype=float)
    n = len(x)
    if n < 6:
        return {"reason": "fewer than 6 values"}
    if max_lag is None:
        max_lag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    max_lag = min(n // 2 - 2, max_lag)
    if max_lag < 0:
        return {"reason": "fewer than 6 values"}
    best = None
    for lags in range(0, max_lag + 1):
        y, X, nobs = _design(x, lags, max_lag)
        _, ssr = _ols(y, X)
        k = X.shape[1]
        if ssr <= EXACT * float(y @ y) or not ssr > 0:
            return {"reason": "exact fit"}
        llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1.0)
        aic = -2.0 * llf + 2.0 * k
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    y, X, nobs = _design(x, lags)
    beta, ssr = _ols(y, X)
    k = X.shape[1]
    sigma2 = ssr / max(nobs - k, 1)
    if nobs <= k or np.linalg.matrix_rank(X) < k or ssr <= EXACT * float(y @ y):
        return {"reason": "exact fit"}
    cov = sigma2 * np.linalg.inv(X.T @ X)
    stat = float(beta[0] / math.sqrt(cov[0, 0]))
    crit = adf_crit(nobs)
    return {"adf_stat": stat, "p_value": adf_pvalue(stat), "used_lag": lags, "nobs": nobs,
            "crit_1pct": crit["1%"], "crit_5pct": crit["5%"], "crit_10pct": crit["10%"], "reason": None}


# A residual sum of squares below this share of the target's counts as an exact fit.
EXACT = 1e-20
ADF_SCHEMA = ("series string, adf_stat double, p_value double, used_lag int, nobs int, "
              "crit_1pct double, crit_5pct double, crit_10pct double, reason string")


def adf_panel(arrays: DataFrame, column: str = "ys", log_diff: bool = False) -> DataFrame:
    """O-8.3 per series over the ``series_arrays`` frame (no shuffle)."""
    def run(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            out = []
            for s, ys in zip(pdf["series"], pdf[column]):
                x = np.asarray(ys, dtype=float)
                if log_diff:
                    if not np.all(x > 0):
                        out.append({"series": s, "reason": "a value is not positive"})
                        continue
                    x = np.diff(np.log(x))
                out.append({"series": s, **adf(x)})
            cols = [c.split()[0] for c in ADF_SCHEMA.split(", ")]
            yield pd.DataFrame(out, columns=cols).astype({"used_lag": "Int32", "nobs": "Int32"})
    return arrays.select("series", column).mapInPandas(run, ADF_SCHEMA)


def levinson_durbin(r) -> list[float]:
    """PACF from autocorrelations r[0..K] (Yule-Walker, biased)."""
    K = len(r) - 1
    pacf = [1.0]
    phi_prev: list[float] = []
    for k in range(1, K + 1):
        num = r[k] - sum(phi_prev[j] * r[k - 1 - j] for j in range(k - 1))
        den = 1.0 - sum(phi_prev[j] * r[j + 1] for j in range(k - 1))
        if den == 0:
            break
        phi_kk = num / den
        phi = [phi_prev[j] - phi_kk * phi_prev[k - 2 - j] for j in range(k - 1)] + [phi_kk]
        pacf.append(phi_kk)
        phi_prev = phi
    return pacf


def pacf(acf_df: DataFrame, max_lag: int = 20) -> DataFrame:
    """O-8.5: partial autocorrelation per series from the ACF table
    (series, k, acf), lags 0..max_lag with lag < n/2, Levinson-Durbin."""
    def per_series(pdf):
        import pandas as pd
        pdf = pdf.sort_values("k")
        n = int(pdf["n"].iloc[0])
        kmax = min(max_lag, (n // 2) - 1, int(pdf["k"].max()))
        r = pdf["acf_raw"].tolist()[:kmax + 1]
        vals = levinson_durbin(r)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "k": list(range(len(vals))), "pacf": vals})
    src = acf_df.select("series", "k", "n", F.col("r").alias("acf_raw"))
    return src.groupBy("series").applyInPandas(per_series, "series string, k int, pacf double")
