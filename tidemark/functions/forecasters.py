"""Numpy estimators for one calendar series at a time; Spark spreads the series over tasks."""

from __future__ import annotations

import numpy as np

# ------------------------------------------------------------------ quantile line


def quantile_line(x: np.ndarray, y: np.ndarray, tau: float) -> tuple[float, float]:
    """Slope and intercept that minimise the tilted absolute loss.

    The loss is convex in the slope once the intercept is the matching quantile, and
    an optimum passes through two points.  Where the loss is flat over a range of
    slopes, the smallest of them is taken, so that the answer is unique.
    """

    def best_at(b: float) -> tuple[float, float]:
        r = np.sort(y - b * x)
        a = r[min(len(r) - 1, max(0, int(np.ceil(tau * len(r))) - 1))]
        e = y - b * x - a
        return float(np.sum(np.where(e >= 0, tau * e, (tau - 1) * e))), float(a)

    spread = np.ptp(x)
    if spread == 0:
        return 0.0, best_at(0.0)[1]
    reach = 2 * np.ptp(y) / np.min(np.diff(np.unique(x)))
    lo, hi, g = -reach, reach, (np.sqrt(5) - 1) / 2
    p, q = hi - g * (hi - lo), lo + g * (hi - lo)
    fp, fq = best_at(p)[0], best_at(q)[0]
    for _ in range(200):
        if fp <= fq:
            hi, q, fq = q, p, fp
            p = hi - g * (hi - lo)
            fp = best_at(p)[0]
        else:
            lo, p, fp = p, q, fq
            q = lo + g * (hi - lo)
            fq = best_at(q)[0]
    b = (lo + hi) / 2
    loss, a = best_at(b)
    low, at = -reach, b  # walk to the left end of the flat stretch, if there is one
    for _ in range(200):
        mid = (low + at) / 2
        low, at = (low, mid) if best_at(mid)[0] <= loss * (1 + 1e-11) else (mid, at)
    a = best_at(at)[1]
    near = np.argsort(np.abs(y - at * x - a), kind="stable")[:6]
    ends = [(y[j] - y[i]) / (x[j] - x[i]) for i in near for j in near if x[j] > x[i]]
    ends = [e for e in ends if abs(e - at) <= 1e-6 * max(abs(at), 1e-3) and best_at(e)[0] <= loss * (1 + 1e-11)]
    b = min(ends, key=lambda e: abs(e - at), default=at)
    return float(b), best_at(b)[1]


# ------------------------------------------------------------------ unit root

# MacKinnon's response surface for the test with a constant.
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SPLIT, ADF_LOW, ADF_HIGH = -1.61, -18.83, 2.74


def augmented_dickey_fuller(y: np.ndarray) -> tuple[float, float, int]:
    """Test statistic, p value and the lag count that minimises the AIC on a common sample."""
    from math import erfc, sqrt

    n, d = len(y), np.diff(y)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def regress(k: int, skip: int):
        rows = np.arange(skip, len(d))
        x = np.column_stack([y[rows], np.ones(len(rows)), *[d[rows - j] for j in range(1, k + 1)]])
        b, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
        e = d[rows] - x @ b
        return b, e @ e, x

    def aic(k: int) -> float:
        _, rss, x = regress(k, top)
        m = len(x)
        return m * (np.log(2 * np.pi * rss / m) + 1) + 2 * x.shape[1]

    k = min(range(top + 1), key=aic)
    b, rss, x = regress(k, k)
    stat = float(b[0] / np.sqrt(rss / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]))
    if stat > ADF_HIGH:
        return stat, 1.0, k
    if stat < ADF_LOW:
        return stat, 0.0, k
    z = sum(c * stat**i for i, c in enumerate(ADF_SMALL if stat <= ADF_SPLIT else ADF_LARGE))
    return stat, 0.5 * erfc(-z / sqrt(2)), k


# ------------------------------------------------------------------ seasonal ARIMA


def _polynomial(coef: np.ndarray, step: int, sign: float) -> np.ndarray:
    out = np.zeros(len(coef) * step + 1)
    out[0] = 1.0
    out[step :: step] = sign * coef
    return out


def arima_forecast(y, steps, order=(1, 1, 1), seasonal=(0, 0, 0), period=12, exog=None, exog_future=None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forecasts, in-sample errors and error variance by conditional least squares.

    Regressors, if given, enter linearly and the errors follow the ARMA model; an
    undifferenced model has a mean.
    """
    y = np.asarray(y, float)
    (p, d, q), (sp, sd, sq) = order, seasonal
    x = np.zeros((len(y), 0)) if exog is None else np.asarray(exog, float)
    xf = np.zeros((steps, 0)) if exog_future is None else np.asarray(exog_future, float)
    if d + sd == 0:
        x, xf = np.column_stack([np.ones(len(y)), x]), np.column_stack([np.ones(steps), xf])
    diff = np.array([1.0])
    for _ in range(d):
        diff = np.convolve(diff, [1.0, -1.0])
    for _ in range(sd):
        diff = np.convolve(diff, _polynomial(np.array([1.0]), period, -1.0))
    m, k = len(diff) - 1, x.shape[1]

    def difference(v):
        return sum(c * v[m - i : len(v) - i] for i, c in enumerate(diff))

    def split(theta):
        beta, rest = theta[:k], theta[k:]
        ar = np.convolve(_polynomial(rest[:p], 1, -1.0), _polynomial(rest[p + q : p + q + sp], period, -1.0))
        ma = np.convolve(_polynomial(rest[p : p + q], 1, 1.0), _polynomial(rest[p + q + sp :], period, 1.0))
        return beta, ar, ma

    def errors(theta):
        beta, ar, ma = split(theta)
        w = difference(y - x @ beta)
        lead = np.convolve(w, ar)[: len(w)]
        e = np.zeros(len(w))
        na, nm = len(ar) - 1, len(ma) - 1
        for t in range(min(na, len(w) - 1), len(w)):
            back = min(nm, t)
            e[t] = lead[t] - ma[1 : back + 1] @ e[t - back : t][::-1]
            if abs(e[t]) > 1e8 * scale:
                return np.full(len(w), 1e8 * scale)
        return e

    scale = np.std(y) + 1e-12
    theta = np.zeros(k + p + q + sp + sq)
    if k:
        theta[:k] = np.linalg.lstsq(x, y, rcond=None)[0]
    theta[k:] = 0.1
    lo, hi = np.full(len(theta), -np.inf), np.full(len(theta), np.inf)
    lo[k:], hi[k:] = -0.99, 0.99
    damp, e = 1e-2, errors(theta)
    for _ in range(200):
        step = 1e-6 * np.maximum(np.abs(theta), 1e-2)
        jac = np.column_stack([(errors(theta + np.eye(len(theta))[i] * step[i]) - e) / step[i] for i in range(len(theta))]) if len(theta) else np.zeros((len(e), 0))
        normal, slope = jac.T @ jac, jac.T @ e
        improved = False
        for _ in range(12):
            trial = np.clip(theta - np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), slope, rcond=None)[0], lo, hi) if len(theta) else theta
            et = errors(trial)
            if et @ et < e @ e * (1 - 1e-12):
                improved, gain = True, 1 - (et @ et) / (e @ e)
                theta, e, damp = trial, et, damp / 3
                break
            damp *= 4
        if not improved or gain < 1e-10:
            break
    beta, ar, ma = split(theta)
    full_ar = np.convolve(ar, diff)
    z = y - x @ beta
    history, shocks, out = list(z), list(np.concatenate([np.zeros(m), e])), []
    for _ in range(steps):
        nxt = -sum(full_ar[i] * history[-i] for i in range(1, min(len(full_ar), len(history) + 1)))
        nxt += sum(ma[i] * shocks[-i] for i in range(1, min(len(ma), len(shocks) + 1)))
        history.append(nxt)
        shocks.append(0.0)
        out.append(nxt)
    return np.array(out) + xf @ beta, e, float(e @ e / max(len(e) - len(theta), 1))


# ------------------------------------------------------------------ Bayesian regressions


def gaussian_process(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sd of a Gaussian process with kernel ``c (RBF(length) + noise I)``.

    Length and noise ratio maximise the marginal likelihood by pattern search; the
    amplitude follows in closed form.
    """
    mean = y.mean()
    r, n = y - mean, len(y)
    dist = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)

    def evidence(log_len, log_noise):
        k = np.exp(-dist / (2 * np.exp(2 * log_len))) + np.exp(log_noise) * np.eye(n)
        try:
            chol = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return -np.inf
        half = np.linalg.solve(chol, r)
        return -0.5 * n * np.log(max(half @ half / n, 1e-300)) - np.log(np.diag(chol)).sum()

    best = max(((evidence(a, b), a, b) for a in np.linspace(-3, 3, 7) for b in np.linspace(-6, 2, 5)), key=lambda v: v[0])
    step = 0.5
    while step > 1e-3:
        around = [(evidence(best[1] + i * step, best[2] + j * step), best[1] + i * step, best[2] + j * step) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        top = max(around, key=lambda v: v[0])
        best, step = (top, step) if top[0] > best[0] else (best, step / 2)
    _, log_len, log_noise = best
    k = np.exp(-dist / (2 * np.exp(2 * log_len))) + np.exp(log_noise) * np.eye(n)
    amplitude = r @ np.linalg.solve(k, r) / n
    cross = np.exp(-((at[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) / (2 * np.exp(2 * log_len)))
    var = amplitude * (1 + np.exp(log_noise) - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)))
    return mean + cross @ np.linalg.solve(k, r), np.sqrt(np.maximum(var, 0))


def ard_from_moments(n: float, cov: np.ndarray, cross: np.ndarray, total: float, rounds: int = 300, prune: float = 1e4) -> np.ndarray:
    """Coefficients with one precision per feature, re-estimated by evidence, from covariances."""
    p = len(cross)
    precision, noise, b = np.ones(p), 1.0 / max(total, 1e-12), np.zeros(p)
    for _ in range(rounds):
        live = precision < prune
        if not live.any():
            return np.zeros(p)
        sigma = np.linalg.inv(noise * n * cov[np.ix_(live, live)] + np.diag(precision[live]))
        new = np.zeros(p)
        new[live] = noise * n * sigma @ cross[live]
        gamma = 1 - precision[live] * np.diag(sigma)
        rss = n * (total - 2 * new @ cross + new @ cov @ new)
        precision[live] = (gamma + 2e-6) / (new[live] ** 2 + 2e-6)
        noise = (n - gamma.sum() + 2e-6) / (max(rss, 1e-12) + 2e-6)
        done = np.abs(new - b).max() < 1e-9 * max(1.0, np.abs(new).max())
        b = new
        if done:
            break
    return b
