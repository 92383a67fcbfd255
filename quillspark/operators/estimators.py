"""Estimators on one group's rows (numpy), to be run per key with applyInPandas.

Series are as long as a study has periods; the groups (pairs, firms, specifications) are what grows, and they are spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from quillspark.functions.tails import f_upper, normal_two_sided, t_two_sided

# Dickey-Fuller quantiles with constant and trend, by sample size, at the probabilities in ADF_P.
ADF_P = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
ADF_N = (25, 50, 100, 250, 500, 100000)
ADF_Q = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)


class Fit:
    """Least squares with the matrices that its standard errors need. Columns without information of their own are dropped."""

    def __init__(self, y: np.ndarray, x: np.ndarray) -> None:
        self.kept = independent(x)
        self.x, self.y = x[:, self.kept], y
        self.n, self.k = self.x.shape
        self.inv = np.linalg.inv(self.x.T @ self.x)
        self.b = self.inv @ (self.x.T @ y)
        self.u = y - self.x @ self.b
        self.rss = float(self.u @ self.u)
        dev = y - y.mean()
        self.r2 = 1 - self.rss / float(dev @ dev) if dev.any() else math.nan

    def hac(self, lags: int, adjust: bool = False) -> np.ndarray:
        """Newey-West covariance, Bartlett weights, no prewhitening; adjust multiplies by n / (n - k)."""
        m = self.x * self.u[:, None]
        s = m.T @ m
        for lag in range(1, lags + 1):
            g = m[lag:].T @ m[:-lag]
            s += (1 - lag / (lags + 1)) * (g + g.T)
        v = self.inv @ s @ self.inv
        return v * self.n / (self.n - self.k) if adjust else v


def independent(x: np.ndarray) -> list[int]:
    """Columns kept from left to right while they add rank."""
    kept: list[int] = []
    for j in range(x.shape[1]):
        if np.linalg.matrix_rank(x[:, [*kept, j]]) > len(kept):
            kept.append(j)
    return kept


def lagged(x: np.ndarray, lags: range) -> np.ndarray:
    """Columns x[t - lag], rows from the largest lag on."""
    top = max(lags)
    return np.stack([x[top - lag : len(x) - lag] for lag in lags], 1)


def with_const(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def usable(y: np.ndarray, x: np.ndarray, least: int) -> bool:
    """Enough observations, and both series vary."""
    return len(y) >= least and np.isfinite(y).all() and np.isfinite(x).all() and y.std() > 0 and x.std() > 0


def hac_line(y: np.ndarray, x: np.ndarray, lags: int = 4) -> dict[str, float] | None:
    """Slope of y on one x, with Newey-West error and t test on n - k degrees."""
    if not usable(y, x, lags + 4):
        return None
    f = Fit(y, with_const(x))
    se = math.sqrt(f.hac(lags)[1, 1])
    return {"b": f.b[1], "se": se, "t": f.b[1] / se, "p": t_two_sided(f.b[1] / se, f.n - f.k), "n": f.n, "r2": f.r2}


def ardl(y: np.ndarray, x: np.ndarray, max_lag: int = 3, least: int = 30) -> list[dict[str, float]]:
    """y on its first lag and x at lags 0 to max_lag: a row per lag and the sum of effects (term -1)."""
    if not usable(y, x, least):
        return []
    xs, own = lagged(x, range(max_lag + 1)), y[max_lag - 1 : -1]
    f = Fit(y[max_lag:], with_const(np.column_stack([xs, own])))
    v = f.hac(3)
    rows = []
    for term, at in [(i, [1 + i]) for i in range(max_lag + 1)] + [(-1, list(range(1, max_lag + 2)))]:
        at = [f.kept.index(a) for a in at if a in f.kept]
        if not at:
            continue
        b, se = float(f.b[at].sum()), math.sqrt(max(0.0, float(v[np.ix_(at, at)].sum())))
        rows.append({"term": term, "b": b, "se": se, "p": t_two_sided(b / se, f.n - f.k) if se else math.nan, "n": f.n, "r2": f.r2})
    return rows


def cumulative(y: np.ndarray, x: np.ndarray, max_h: int = 12) -> list[dict[str, float]]:
    """Cumulative effect of x over 1 to max_h months (lags 0 to h - 1), delta-method error, normal p value."""
    rows = []
    for h in range(1, max_h + 1):
        if not usable(y, x, max(36, max_h + 10)):
            return rows
        xs = lagged(x, range(h))
        f = Fit(y[h - 1 :], with_const(xs))
        if len(f.kept) < h + 1:
            rows.append({"h": h, "effect": math.nan, "se": math.nan, "p": math.nan, "n": f.n})
            continue
        v = f.hac(min(6, f.n // 4), adjust=True)
        b, se = float(f.b[1:].sum()), math.sqrt(max(0.0, float(v[1:, 1:].sum())))
        rows.append({"h": h, "effect": b, "se": se, "p": normal_two_sided(b / se) if se else math.nan, "n": f.n})
    return rows


def granger(y: np.ndarray, x: np.ndarray, order: int = 2) -> dict[str, float] | None:
    """F test that lags of x add nothing to lags of y."""
    if not usable(y, x, 3 * order + 4):
        return None
    ys, xs = lagged(y, range(1, order + 1)), lagged(x, range(1, order + 1))
    small, large = Fit(y[order:], with_const(ys)), Fit(y[order:], with_const(np.column_stack([ys, xs])))
    d1, d2 = large.k - small.k, large.n - large.k
    f = ((small.rss - large.rss) / d1) / (large.rss / d2)
    return {"f": f, "p": f_upper(f, d1, d2), "n": large.n}


def adf(x: np.ndarray, least: int = 10) -> dict[str, float] | None:
    """Augmented Dickey-Fuller with constant and trend; p is interpolated in the table and stays within it."""
    if len(x) < least or not np.isfinite(x).all() or x.std() == 0:
        return None
    k = int((len(x) - 1) ** (1 / 3)) + 1
    dx = np.diff(x)
    n = len(dx)
    cols = [x[k - 1 : n], np.ones(n - k + 1), np.arange(k, n + 1, dtype=float), *(dx[k - 1 - i : n - i] for i in range(1, k))]
    f = Fit(dx[k - 1 :], np.column_stack(cols))
    if f.n <= f.k or 0 not in f.kept:
        return None
    t = f.b[0] / math.sqrt(f.inv[0, 0] * f.rss / (f.n - f.k))
    quantiles = [np.interp(n, ADF_N, [row[j] for row in ADF_Q]) for j in range(len(ADF_P))]
    return {"t": float(t), "p": float(np.interp(t, quantiles, ADF_P)), "lags": k - 1, "n": len(x)}


def var_fit(z: np.ndarray, p: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (constant first), residuals and AIC of a vector autoregression; rows from `start` on."""
    s = p if start is None else start
    x = with_const(np.column_stack([z[s - i : len(z) - i] for i in range(1, p + 1)]))
    b, *_ = np.linalg.lstsq(x, z[s:], rcond=None)
    u = z[s:] - x @ b
    n, m = u.shape
    aic = math.log(max(np.linalg.det(u.T @ u / n), 1e-300)) + 2 * m * (m * p + 1) / n
    return b, u, aic


def var_order(z: np.ndarray, most: int = 6) -> int:
    """Order by AIC; all orders are fitted to the same rows."""
    top = max(1, min(most, len(z) // 5))
    return min(range(1, top + 1), key=lambda p: var_fit(z, p, top)[2])


def responses(b: np.ndarray, u: np.ndarray, p: int, ahead: int) -> np.ndarray:
    """Orthogonalised responses of the first variable to a shock of the second."""
    m = u.shape[1]
    a = [b[1 + i * m : 1 + (i + 1) * m].T for i in range(p)]
    chol = np.linalg.cholesky(u.T @ u / (len(u) - m * p - 1) + 1e-15 * np.eye(m))
    psi = [np.eye(m)]
    for h in range(1, ahead + 1):
        psi.append(sum(a[i] @ psi[h - 1 - i] for i in range(min(p, h))))
    return np.array([(x @ chol)[0, 1] for x in psi])


def irf(y: np.ndarray, x: np.ndarray, ahead: int = 12, runs: int = 200, seed: int = 42, least: int = 30) -> list[dict[str, float]]:
    """Impulse responses of y to x in the order (y, x), with a residual-bootstrap band."""
    if not usable(y, x, least):
        return []
    z = np.column_stack([y, x])
    p = var_order(z)
    b, u, _ = var_fit(z, p)
    point = responses(b, u, p, ahead)
    rng, draws = np.random.default_rng(seed), []
    for _ in range(runs):
        e = (u - u.mean(0))[rng.integers(0, len(u), len(u))]
        path = [*z[:p]]
        for t in range(len(u)):
            path.append(b[0] + sum(path[p + t - i] @ b[1 + (i - 1) * 2 : 1 + i * 2] for i in range(1, p + 1)) + e[t])
        bb, uu, _ = var_fit(np.array(path), p)
        draws.append(responses(bb, uu, p, ahead))
    lo, hi = np.quantile(draws, [0.025, 0.975], axis=0)
    return [{"h": h, "irf": float(point[h]), "lower": float(lo[h]), "upper": float(hi[h]), "order": p, "star": "*" if np.sign(lo[h]) == np.sign(hi[h]) else ""} for h in range(ahead + 1)]


def sup_f(y: np.ndarray, x: np.ndarray, trim: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Break candidates (first position of the second regime, from 1) and their F statistics, from prefix sums."""
    n = len(y)
    ks = np.arange(math.floor(trim * n), math.ceil((1 - trim) * n) + 1)
    s = np.vstack([np.zeros(6), np.cumsum(np.column_stack([np.ones(n), x, y, x * x, x * y, y * y]), 0)])

    def rss(v: np.ndarray) -> np.ndarray:
        c, sx, sy, sxx, sxy, syy = v.T
        xx, xy, yy = sxx - sx * sx / c, sxy - sx * sy / c, syy - sy * sy / c
        return yy - np.where(xx > 0, xy * xy / np.where(xx > 0, xx, 1), 0)

    split = rss(s[ks - 1]) + rss(s[n] - s[ks - 1])
    return ks, ((rss(s[n : n + 1]) - split) / 2) / (split / (n - 4))


def sup_f_draws(y: np.ndarray, x: np.ndarray, seeds: np.ndarray, trim: float = 0.15) -> list[float]:
    """The largest F of resampled residuals under no break, one for each seed."""
    f = Fit(y, with_const(x))
    fitted = f.x @ f.b
    return [float(sup_f(fitted + f.u[np.random.default_rng(int(s)).integers(0, len(y), len(y))], x, trim)[1].max()) for s in seeds]


def _loess_at(y: np.ndarray, at: float, left: int, right: int, length: int, degree: int, n: int) -> float:
    """Local fit at a place from positions left to right (from 1), tricube weights."""
    h = max(at - left, right - at)
    if length > n:
        h += (length - n) // 2
    j = np.arange(left, right + 1, dtype=float)
    r = np.abs(j - at)
    w = np.where(r <= 0.999 * h, np.where(r <= 0.001 * h, 1.0, (1 - (r / h) ** 3) ** 3), 0.0) if h > 0 else np.ones(len(j))
    w = w / w.sum()
    if degree > 0 and h > 0:
        a = w @ j
        c = w @ (j - a) ** 2
        if math.sqrt(c) > 0.001 * (n - 1):
            w = w * ((at - a) / c * (j - a) + 1)
    return float(w @ y[left - 1 : right])


def _loess(y: np.ndarray, length: int, degree: int, jump: int) -> np.ndarray:
    """Smooths at every jump-th position and the last; lines between."""
    n = len(y)
    if n < 2:
        return y.copy()
    jump = min(jump, n - 1)
    places = list(range(1, n + 1, jump))
    if places[-1] != n:
        places.append(n)
    half = (length + 1) // 2
    values = []
    for i in places:
        left = 1 if length >= n else min(max(1, i - half + 1), n - length + 1)
        right = n if length >= n else left + length - 1
        values.append(_loess_at(y, i, left, right, length, degree, n))
    return np.interp(np.arange(1, n + 1), places, values)


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    c = np.append(0.0, np.cumsum(x))
    return (c[k:] - c[:-k]) / k


def stl_periodic(y: np.ndarray, period: int = 12) -> np.ndarray:
    """The periodic seasonal part of a series: two rounds of cycle means, low-pass and trend smoothing."""
    n = len(y)
    s_len = 10 * n + 1
    t_len = math.ceil(1.5 * period / (1 - 1.5 / s_len))
    t_len += 1 - t_len % 2
    l_len = period + 1 - period % 2
    jump = lambda k: math.ceil(k / 10)
    trend = np.zeros(n)
    for _ in range(2):
        detrended, cycle = y - trend, np.zeros(n + 2 * period)
        for j in range(period):
            sub = detrended[j::period]
            k = len(sub)
            inner = _loess(sub, s_len, 0, jump(s_len))
            first = _loess_at(sub, 0, 1, min(s_len, k), s_len, 0, k)
            last = _loess_at(sub, k + 1, max(1, k - s_len + 1), k, s_len, 0, k)
            cycle[j::period][: k + 2] = np.concatenate([[first], inner, [last]])
        low = _loess(_moving(_moving(_moving(cycle, period), period), 3), l_len, 1, jump(l_len))
        seasonal = cycle[period : period + n] - low
        trend = _loess(y - seasonal, t_len, 1, jump(t_len))
    means = np.array([seasonal[j::period].mean() for j in range(period)])
    return means[np.arange(n) % period]


def frame(rows: list[dict], columns: list[str], **keys: object) -> pd.DataFrame:
    """Rows with the group's keys in front; an empty frame with the same columns if there are none."""
    out = pd.DataFrame(rows, columns=columns)
    for i, (k, v) in enumerate(keys.items()):
        out.insert(i, k, v)
    return out
