"""Exact Gaussian likelihood of ARIMA(p, 1, q), p <= 2, q <= 1, for many series.

The differenced series follows x_t = phi1 x_{t-1} + phi2 x_{t-2} + e_t + theta
e_{t-1}.  In state-space form the state is (x_t, phi2 x_{t-1} + theta e_t); it
begins in its stationary distribution, and a Kalman filter yields the one-step
errors v_t with variances f_t (in units of the innovation variance, which is
concentrated out).  Minimized is n log(sum v_t^2 / f_t / n) + sum log f_t, which
is -2 log likelihood up to a constant.  An observation is exact, so of the state
covariance only three numbers remain, and after the first step two are fixed.

Series of one length and all parameter points advance through time together.
The search is a grid over the stationary and invertible region and then rounds
of finer grids around the best point, each ``RATIO`` times finer and wide enough
to leave the point's own cell; ties go to the smallest parameters.  The last
step is under 1e-4, so estimates hold to four digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RATIO = 5
TINY = 1e-300  # stands for a sum of squares of zero
POINTS = 32_768  # series x parameter points advanced at once: their arrays stay in a core's cache
TOGETHER = 512  # series searched together
NEAR = 1e-7  # more than rounding can move an objective in the scan
PERFECT = 1e-8  # share of a series' squares below which a sum of squares is mostly rounding


@dataclass(frozen=True)
class Spec:
    """Grid of one model: greatest |phi1|, |phi2|, |theta| in steps of 1 / div, then ``rounds`` finer ones of
    ``window`` steps to either side."""

    p: int
    q: int
    div: int
    rounds: int
    window: int

    def limits(self, div: int) -> tuple[int, int, int]:
        wide = 2 * div - 1 if self.p == 2 else div - 1
        return wide, (div - 1 if self.p == 2 else 0), (div - 1 if self.q else 0)

    def divs(self) -> list[int]:
        return [self.div * RATIO ** (i + 1) for i in range(self.rounds)]


SPECS = {"ARIMA(1,1,0)": Spec(1, 0, 20, 4, 9), "ARIMA(1,1,1)": Spec(1, 1, 20, 4, 9), "ARIMA(2,1,1)": Spec(2, 1, 10, 5, 6)}


def _start(phi1, phi2, theta):
    """Covariance (p11, p12, p22) of the stationary state."""
    q = 1.0 - phi2
    p11 = ((1.0 + theta * theta) * q + 2.0 * phi1 * theta) / ((1.0 + phi2) * (q - phi1) * (q + phi1))
    return p11, (phi1 * phi2 * p11 + theta) / q, phi2 * phi2 * p11 + theta * theta


def kalman(z: np.ndarray, phi1, phi2, theta):
    """``z``: (series, time); parameters broadcast to (series, points).  Returns the
    objective and the predicted state (a1, a2) after the last observation."""
    p11, p12, p22 = _start(phi1, phi2, theta)
    shape = np.broadcast_shapes(p11.shape, (z.shape[0], 1))
    a1, a2, sse, logs = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    f = np.broadcast_to(p11, shape)
    for t in range(z.shape[1]):
        x = z[:, t][:, None]
        v = x - a1
        sse = sse + v * v / f
        logs = logs + np.log(f)
        a1, a2 = phi1 * x + (a2 + p12 * v / f), phi2 * x
        f = 1.0 + (p22 - p12 * p12 / f)
        p12, p22 = theta, theta * theta
    n = float(z.shape[1])
    return n * np.log(np.maximum(sse / n, TINY)) + logs, a1, a2


def _gains(steps: int, phi1, phi2, theta):
    """Each step's 1 / f and p12 / f, and the sum of log f: they depend on parameters only."""
    f, p12, p22 = _start(phi1, phi2, theta)
    out, logs = [], np.zeros(f.shape)
    for _ in range(steps):
        out.append((1.0 / f, p12 / f))
        logs += np.log(f)
        f, p12, p22 = 1.0 + (p22 - p12 * p12 / f), theta, theta * theta
    return out, logs


def _scan(z: np.ndarray, phi1, phi2, theta, gains=None):
    """Sum of v^2 / f and of log f as in :func:`kalman`, up to rounding: one division a step (none with ``gains``), one
    logarithm a point, and arrays used again from step to step."""
    shape = np.broadcast_shapes(phi1.shape, (z.shape[0], 1))
    a1, a2, sse, v, w = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.empty(shape), np.empty(shape)
    second, moving = bool(np.any(phi2)), bool(np.any(theta))
    if gains is None:
        f, gain, p22 = _start(phi1, phi2, theta)
        product, inverse, square, later = np.ones(shape), np.empty(shape), gain * gain, theta * theta
    for t in range(z.shape[1]):
        x = z[:, t][:, None]
        np.subtract(x, a1, out=v)
        np.multiply(phi1, x, out=a1)
        if not moving and t > 1:  # f is 1 and p12 is 0
            np.multiply(v, v, out=w)
        elif gains is not None:
            inverse, gain = gains[t]
            np.multiply(v, v, out=w)
            w *= inverse
            v *= gain
            a1 += v
        else:
            product *= f
            np.divide(1.0, f, out=inverse)
            np.multiply(v, inverse, out=w)
            w *= v
            v *= inverse
            v *= gain
            a1 += v
            f = square * inverse
            np.subtract(1.0 + p22, f, out=f)
            gain, p22, square = theta, later, later
        sse += w
        if second:
            a1 += a2
            np.multiply(phi2, x, out=a2)
    return sse, None if gains is not None else np.log(product)


def _valid(k: np.ndarray, spec: Spec, div: int) -> np.ndarray:
    l1, l2, lt = spec.limits(div)
    ok = (np.abs(k[..., 0]) <= l1) & (np.abs(k[..., 1]) <= l2) & (np.abs(k[..., 2]) <= lt)
    return ok & (k[..., 1] + k[..., 0] < div) & (k[..., 1] - k[..., 0] < div) & (k[..., 1] > -div)


def _coarse(spec: Spec) -> np.ndarray:
    l1, l2, lt = spec.limits(spec.div)
    k = np.stack(np.meshgrid(*(np.arange(-n, n + 1) for n in (l1, l2, lt)), indexing="ij"), axis=-1).reshape(-1, 3)
    return k[_valid(k, spec, spec.div)]


def _fine(spec: Spec) -> np.ndarray:
    w = np.arange(-spec.window, spec.window + 1)
    return np.stack(np.meshgrid(w, w if spec.p == 2 else [0], w if spec.q else [0], indexing="ij"), axis=-1).reshape(-1, 3)


def _best(z: np.ndarray, centre: np.ndarray | None, around: np.ndarray, spec: Spec, div: int):
    """Points ``around`` each series' ``centre`` (None: the same for all) -> best k, objective and state of every series.

    A scan finds the points whose objective may be the least; theirs is then taken from :func:`kalman`.  Where the fit is
    all but perfect, rounding decides in the scan, so all points are such."""
    gains = logs = None
    step = max(1, POINTS // len(around))
    rows, cols = [], []
    for at in range(0, len(z), step):
        part = z[at:at + step]
        k = around[None] if centre is None else centre[at:at + step, None, :] * RATIO + around[None]
        valid = _valid(k, spec, div)
        # Points outside the region are computed as (0, 0, 0) and left out after.
        f1, f2, th = (np.where(valid, k[..., i], 0) / float(div) for i in range(3))
        if centre is None and gains is None:
            gains, logs = _gains(z.shape[1], f1, f2, th)
        sse, some = _scan(part, f1, f2, th, gains)
        n = float(z.shape[1])
        sse = np.where(valid, sse, np.inf)
        obj = n * np.log(np.maximum(sse / n, TINY)) + (logs if some is None else some)
        unsure = sse.min(axis=1) <= PERFECT * (part * part).sum(axis=1)
        r, c = np.nonzero(((obj <= obj.min(axis=1, keepdims=True) + NEAR) | unsure[:, None]) & valid)
        rows.append(r + at)
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    found = []
    for at in range(0, len(rows), POINTS):
        r, c = rows[at:at + POINTS], cols[at:at + POINTS]
        k = around[c] if centre is None else centre[r] * RATIO + around[c]
        f1, f2, th = (k[:, i, None] / float(div) for i in range(3))
        found.append((k, *(x[:, 0] for x in kalman(z[r], f1, f2, th))))
    k, obj, a1, a2 = (np.concatenate(x) for x in zip(*found))
    # Points are in ascending order of (phi1, phi2, theta): the first of equal ones is the smallest.
    order = np.lexsort((cols, obj, rows))
    i = order[np.searchsorted(rows[order], np.arange(len(z)))]
    return k[i], obj[i], a1[i], a2[i]


def fit(series: list[np.ndarray], model: str) -> list[tuple | None]:
    """Differenced log series -> (phi1, phi2, theta, a1, a2, objective), or None
    for a series that is too short (no longer than p, or one value for p = 1, q = 0) or has no variation to fit (1, 1, 0) to."""
    spec = SPECS[model]
    out: list[tuple | None] = [None] * len(series)
    by_length: dict[int, list[int]] = {}
    for i, z in enumerate(series):
        if len(z) > spec.p and (spec.q or np.any(z[:-1] != 0)):
            by_length.setdefault(len(z), []).append(i)
    coarse, fine = _coarse(spec), _fine(spec)
    for ids in by_length.values():
        for at in range(0, len(ids), TOGETHER):
            some = ids[at:at + TOGETHER]
            z = np.stack([np.asarray(series[i], float) for i in some])
            k, obj, a1, a2 = _best(z, None, coarse, spec, spec.div)
            div = spec.div
            for div in spec.divs():
                k, obj, a1, a2 = _best(z, k, fine, spec, div)
            for j, i in enumerate(some):
                out[i] = (*(float(x) / div for x in k[j]), float(a1[j]), float(a2[j]), float(obj[j]))
    return out


def forecast(last: float, phi1: float, phi2: float, a1: float, a2: float, steps: int) -> list[float]:
    """Forecasts on the original scale: the differences' predictions, summed and exponentiated."""
    import math
    x, out = last, []
    for _ in range(steps):
        x = x + a1
        out.append(math.exp(x))
        a1, a2 = phi1 * a1 + a2, phi2 * a1
    return out
