"""Forecast and series operators against brute-force NumPy / Python loops."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tijara.operators import arima as AR
from tijara.operators import forecast as FC
from tijara.operators import stationarity as ST


NILE = [1120, 1160, 963, 1210, 1160, 1160, 813, 1230, 1370, 1140, 995, 935, 1110, 994, 1020, 960, 1180, 799, 958, 1140,
        1100, 1210, 1150, 1250, 1260, 1220, 1030, 1100, 774, 840, 874, 694, 940, 833, 701, 916, 692, 1020, 1050, 969, 831,
        726, 456, 824, 702, 1120, 1100, 832, 764, 821, 768, 845, 864, 862, 698, 845, 744, 796, 1040, 759, 781, 865, 845,
        944, 984, 897, 822, 1010, 771, 676, 649, 846, 812, 742, 801, 1040, 860, 874, 848, 890, 744, 749, 838, 1050, 918,
        986, 797, 923, 975, 815, 1020, 906, 901, 1170, 912, 746, 919, 718, 714, 740]


def dense_objective(z, phi1, phi2, theta):
    """-2 log likelihood without constants, from the covariance matrix of the whole series."""
    n, m = len(z), 4000
    psi = np.zeros(m)  # moving-average weights
    psi[0] = 1.0
    for j in range(1, m):
        psi[j] = phi1 * psi[j - 1] + (phi2 * psi[j - 2] if j > 1 else 0.0) + (theta if j == 1 else 0.0)
    acov = np.array([psi[:m - k] @ psi[k:] for k in range(n)])
    cov = acov[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    return n * np.log(z @ np.linalg.solve(cov, z) / n) + np.linalg.slogdet(cov)[1]


def test_kalman_likelihood_is_that_of_the_covariance_matrix():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(2, 40))
    for phi1, phi2, theta in [(0.5, 0.0, 0.3), (-0.8, 0.0, 0.0), (1.2, -0.5, -0.7), (0.1, 0.6, 0.9), (0.0, 0.0, -0.95)]:
        got, a1, a2 = AR.kalman(z, *(np.array([[v]]) for v in (phi1, phi2, theta)))
        for i in range(2):
            assert abs(got[i, 0] - dense_objective(z[i], phi1, phi2, theta)) < 1e-6


def test_exact_arima_of_a_published_series():
    """ARIMA(1,1,1) of the annual flow of the Nile: published exact estimates
    ar 0.2544, ma -0.8741, innovation variance 19769, log likelihood -630.63."""
    z = np.diff(np.array(NILE, float))
    phi1, phi2, theta, _a1, _a2, obj = AR.fit([z], "ARIMA(1,1,1)")[0]
    assert abs(phi1 - 0.2544) < 1e-4 and phi2 == 0 and abs(theta + 0.8741) < 1e-4
    n = len(z)
    assert abs(-0.5 * (obj + n * np.log(2 * np.pi) + n) + 630.63) < 0.01


@pytest.mark.parametrize("model", list(AR.SPECS))
def test_fit_is_the_best_point_around_and_afar(model):
    rng = np.random.default_rng(7)
    e = rng.normal(size=(6, 61))
    zs = [0.6 * np.roll(x, 1)[1:] + x[1:] + 0.2 * np.roll(x, 2)[1:] for x in e] + [np.diff(np.log(np.array(NILE, float))), rng.normal(size=25)]
    spec = AR.SPECS[model]
    for z, got in zip(zs, AR.fit(zs, model)):
        best = got[5]
        assert abs(dense_objective(z, *got[:3]) - best) < 1e-5
        for _ in range(60):
            near = [got[0] + rng.normal() * 3e-4, got[1] + rng.normal() * 3e-4 * (spec.p == 2), got[2] + rng.normal() * 3e-4 * spec.q]
            far = [rng.uniform(-0.95, 0.95), rng.uniform(-0.9, 0.0) * (spec.p == 2), rng.uniform(-0.95, 0.95) * spec.q]
            for x in (near, far):
                if abs(x[0]) < 1 - abs(x[1]) and abs(x[2]) < 1:
                    assert AR.kalman(z[None], *(np.array([[v]]) for v in x))[0][0, 0] > best - 1e-5


def test_series_fitted_together_are_fitted_as_alone():
    rng = np.random.default_rng(9)
    zs = [rng.normal(size=n) for n in (30, 30, 12, 47, 30, 2, 1)] + [np.zeros(9)]
    for model in AR.SPECS:
        together = AR.fit(zs, model)
        assert together == [AR.fit([z], model)[0] for z in zs]
        assert together[6] is None and (together[7] is None) == (model == "ARIMA(1,1,0)")


def test_forecast_continues_the_state():
    """Predictions of the filter are the conditional means: for an AR(2) the recursion itself."""
    z = np.array([0.3, -0.1, 0.4, 0.2])
    _, a1, a2 = AR.kalman(z[None], np.array([[0.5]]), np.array([[0.2]]), np.array([[0.0]]))
    one = 0.5 * 0.2 + 0.2 * 0.4
    two = 0.5 * one + 0.2 * 0.2
    assert np.allclose(np.log(AR.forecast(0.0, 0.5, 0.2, a1[0, 0], a2[0, 0], 2)), [one, one + two])


def test_ses_search_is_the_best_fit():
    ys = [10.0, 12.0, 9.0, 14.0, 13.0, 15.0, 11.0]

    def sse(alpha, l0):
        lev, out = l0, 0.0
        for y in ys:
            out += (y - lev) ** 2
            lev += alpha * (y - lev)
        return out, lev
    best = min((sse(k / 1000, l0 / 50)[0], k, l0) for k in range(1, 1000, 3) for l0 in range(0, 1000, 5))
    got = FC.ses_search(ys)
    assert abs(got - sse(best[1] / 1000, best[2] / 50)[1]) < 0.1


def test_adf_gives_a_reason_instead_of_failing():
    assert ST.adf([5.0] * 30)["reason"] == "exact fit" and ST.adf([float(i) for i in range(30)])["reason"] == "exact fit"
    assert ST.adf([1.0, 2.0])["reason"] == "fewer than 6 values"
    assert ST.adf(np.random.default_rng(0).normal(size=60))["reason"] is None


def test_gap_is_a_month(spark):
    """A missing month becomes a zero month: growth compares neighbours in time."""
    from datetime import date

    from tijara.operators import timeseries as TS
    p = spark.createDataFrame([("s", date(2024, 1, 1), 10.0, 1), ("s", date(2024, 3, 1), 30.0, 2)], "series string, period date, y double, orders long")
    full = TS.fill_gaps(p, F.lit(date(2024, 4, 1)))
    got = {r.period.month: (r.y, r.growth_pct) for r in TS.growth(full).collect()}
    assert got == {1: (10.0, None), 2: (0.0, -100.0), 3: (30.0, None), 4: (0.0, -100.0)}


def test_refit_falls_back_and_says_so(spark):
    """The best model by holdout cannot be refit: the next scored one is used."""
    m = spark.createDataFrame([("s", "ARIMA(1,1,0)", 1.0, 1.0), ("s", "Naive", 2.0, 2.0), ("s", "Drift", 3.0, 3.0)],
                              "series string, model string, mae double, rmse double")
    fin = spark.createDataFrame([("s", "Naive", h, None, 5.0) for h in (1, 2, 3)] + [("s", "Drift", h, None, 6.0) for h in (1, 2, 3)],
                                "series string, model string, h long, period date, forecast double")
    got = FC.final_forecast(fin, m).collect()
    assert {(r.model, r.fallback) for r in got} == {("Naive", True)} and len(got) == 3


def test_forecast_models_on_a_toy_panel(spark):
    from datetime import date
    rows = [("s", date(2020 + (m // 12), m % 12 + 1, 1), float(100 + m + 10 * (m % 12 == 5))) for m in range(30)]
    panel = spark.createDataFrame(rows, "series string, period date, y double")
    f = FC.fit_frame(FC.series_arrays(panel), "eval")
    fc = {(r.model, r.h): r.forecast for r in FC.forecasts(f).collect()}
    train = [r[2] for r in rows[:24]]
    assert fc[("Naive", 1)] == train[-1]
    assert math.isclose(fc[("Average", 2)], sum(train) / 24)
    assert math.isclose(fc[("Drift", 3)], train[-1] + 3 * (train[-1] - train[0]) / 23)
    # seasonal naive: month 6 of the test year -> last June in training
    assert fc[("Seasonal Naive", 6)] == train[17]
    sel = FC.select_model(FC.metrics(FC.forecasts(f))).collect()
    assert len(sel) == 1


def test_seasonal_naive_unseen_month_is_unscored(spark):
    from datetime import date
    rows = [("s", date(2020, m, 1), float(m)) for m in range(1, 11)]
    panel = spark.createDataFrame(rows, "series string, period date, y double")
    f = FC.fit_frame(FC.series_arrays(panel), "eval")  # test = Sep, Oct; train Jan..Aug
    m = {r.model for r in FC.metrics(FC.forecasts(f, ["Seasonal Naive", "Naive"])).collect()}
    assert m == {"Naive"}


def test_adf_statistic_matches_direct_ols():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=120))
    r = ST.adf(x, max_lag=0)
    dx = np.diff(x)
    X = np.column_stack([x[:-1], np.ones(len(dx))])
    beta, res, *_ = np.linalg.lstsq(X, dx, rcond=None)
    resid = dx - X @ beta
    s2 = resid @ resid / (len(dx) - 2)
    se = math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])
    assert math.isclose(r["adf_stat"], beta[0] / se, rel_tol=1e-9)
    assert r["p_value"] > 0.05  # a random walk is not stationary
    stationary = ST.adf(rng.normal(size=200))
    assert stationary["p_value"] < 0.01


def test_adf_pvalue_monotone_and_bounded():
    vals = [ST.adf_pvalue(s) for s in np.linspace(-20, 3, 200)]
    assert all(0.0 <= v <= 1.0 for v in vals)
    assert all(b >= a - 1e-12 for a, b in zip(vals, vals[1:]))


def test_levinson_durbin_matches_yule_walker_solve():
    r = [1.0, 0.6, 0.3, 0.1, -0.05]
    p = ST.levinson_durbin(r)
    for k in range(1, len(r)):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(R, np.array(r[1:k + 1]))
        assert math.isclose(p[k], phi[-1], rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 500, 20_000])
def test_quantiles_are_exact_at_every_size(spark, n):
    from tijara.operators.quantiles import quantiles
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n).round(3))  # a frequent value
    df = spark.createDataFrame([("k" if i % 3 else "j", float(v)) for i, v in enumerate(x)] + [("k", None)], "g string, v double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
    groups = {"k": x[[i for i in range(n) if i % 3]], "j": x[[i for i in range(n) if i % 3 == 0]]}
    for r in quantiles(df, ["g"], F.col("v"), probs, linear=True).collect():
        assert np.allclose(r.q, np.quantile(groups[r.g], probs))
    for r in quantiles(df, ["g"], F.col("v"), probs, linear=False).collect():
        v = np.sort(groups[r.g])
        assert r.q == [v[max(math.ceil(p * len(v)) - 1, 0)] for p in probs]
    whole = quantiles(df, [], F.col("v"), probs, linear=True).first().q
    assert np.allclose(whole, np.quantile(x, probs))


def test_the_scan_of_a_fit_finds_the_least_objective_of_the_filter():
    rng = np.random.default_rng(9)
    zs = np.stack([*rng.normal(0, 0.5, (6, 24)), np.zeros(24), np.full(24, 0.1), np.round(rng.normal(0, 1, 24), 1)])
    for spec in AR.SPECS.values():
        for centre, around, div in ((None, AR._coarse(spec), spec.div), (np.zeros((len(zs), 3), int), AR._fine(spec), spec.div * AR.RATIO)):
            k, obj, _a1, _a2 = AR._best(zs, centre, around, spec, div)
            some = around[AR._valid(around, spec, div)]
            every, _, _ = AR.kalman(zs, *(some[None, :, i] / float(div) for i in range(3)))
            assert np.array_equal(obj, every.min(axis=1))
            assert np.array_equal(k, some[every.argmin(axis=1)])


def test_ses_of_many_series_is_that_of_each():
    rng = np.random.default_rng(4)
    many = [list(rng.normal(50, 9, n)) for n in (5, 9, 9, 5, 30)] + [[0.0, 0.0], [7.0]]
    assert FC.ses_levels(many) == [FC.ses_search(y) for y in many]


def test_forecasts_of_many_series_are_made_once_and_without_a_shuffle(spark):
    from tijara.plans.q_time import _final

    arrays = spark.sql("SELECT cast(s AS string) AS series, transform(sequence(0, 17), i -> add_months(date'2020-01-01', i)) AS periods, "
                       "transform(sequence(0, 17), i -> cast(100 + (i * i * (s + 3)) % 17 AS double)) AS ys, 18 AS n FROM range(4) t(s)")
    arrays = arrays.withColumn("_s", F.expr("transform(arrays_zip(periods, ys), x -> struct(x.periods AS period, x.ys AS y))"))
    rows = FC.forecast_rows(FC.fit_frame(arrays, "eval"))
    assert not any(x in rows._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join"))
    assert sorted(FC.row_metrics(rows).collect()) == sorted(FC.metrics(FC.long_rows(rows)).collect())
    # The refits are joined twice: they are read, not fitted again.
    assert "InArrow" not in _final(spark, "/root/testdata/sf0.001", "category")._jdf.queryExecution().executedPlan().toString()
