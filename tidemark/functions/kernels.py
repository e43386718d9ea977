"""Small numpy kernels that run inside Spark tasks, one ordered series at a time."""

from __future__ import annotations

import numpy as np


def sign_before(v: np.ndarray) -> np.ndarray:
    """For each position, how many earlier values are smaller minus how many are larger."""
    v = np.asarray(v, float)
    out = np.zeros(len(v), np.int64)

    def merge(lo: int, hi: int) -> None:
        if hi - lo <= 256:
            part = v[lo:hi]
            signs = np.sign(part[:, None] - part[None, :])
            out[lo:hi] += np.tril(signs, -1).sum(axis=1).astype(np.int64)
            return
        mid = (lo + hi) // 2
        merge(lo, mid)
        merge(mid, hi)
        left = np.sort(v[lo:mid])
        right = v[mid:hi]
        out[mid:hi] += np.searchsorted(left, right, "left") + np.searchsorted(left, right, "right") - len(left)

    merge(0, len(v))
    return out


def theil_sen(x: np.ndarray, y: np.ndarray, chunk_pairs: int = 4_000_000) -> float:
    """Median slope over all pairs with different ``x``, holding a bounded number of slopes at a time.

    Short series take the median outright.  Longer ones narrow an interval around
    the two middle ranks until its slopes fit into memory.
    """
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)

    def slopes(lo: float, hi: float):
        rows = max(1, chunk_pairs // max(n, 1))
        for i in range(0, n - 1, rows):
            j = np.arange(n)
            a = np.arange(i, min(i + rows, n - 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (y[None, :] - y[a, None]) / (x[None, :] - x[a, None])
            s = s[(j[None, :] > a[:, None]) & (x[None, :] > x[a, None])]
            yield s[(s > lo) & (s <= hi)], int((s <= lo).sum()), len(s)

    lo, hi = -np.inf, np.inf
    below, total = 0, sum(t for _, _, t in slopes(-np.inf, -np.inf))
    if total == 0:
        return float("nan")
    ranks = ((total - 1) // 2, total // 2)
    inside = total
    while inside > chunk_pairs:
        sample = np.concatenate([s[:: max(1, len(s) // 2000)] for s, _, _ in slopes(lo, hi) if len(s)])
        target = np.clip((ranks[0] - below) / inside, 0, 1)
        a, b = np.quantile(sample, [max(0.0, target - 0.05), min(1.0, target + 0.05)])
        counts = [(len(s), under) for s, under, _ in slopes(a, b)]
        kept, under = sum(c for c, _ in counts), sum(u for _, u in counts)
        if not (under <= ranks[0] and ranks[1] < under + kept) or kept == inside:
            break
        lo, hi, below, inside = a, b, under, kept
    found = np.sort(np.concatenate([s for s, _, _ in slopes(lo, hi)]))
    return float((found[ranks[0] - below] + found[ranks[1] - below]) / 2)


# ------------------------------------------------------------------ wavelets

# Support and sampling of the mother wavelets, and the centre frequency of each.
WAVELET_BOUND, WAVELET_POINTS = 8.0, 1024
WAVELET_CENTRE = {"morl": 0.8125, "cmor1.5-1.0": 1.0}


def mother_wavelet(name: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(-WAVELET_BOUND, WAVELET_BOUND, WAVELET_POINTS)
    if name == "morl":
        return x, np.exp(-(x**2) / 2) * np.cos(5 * x)
    width, centre = (float(v) for v in name.removeprefix("cmor").split("-"))
    return x, np.exp(-(x**2) / width) * np.exp(2j * np.pi * centre * x) / np.sqrt(np.pi * width)


def cwt(y: np.ndarray, scales: np.ndarray, name: str) -> np.ndarray:
    """Continuous wavelet transform, one row per scale.

    The wavelet's running integral is stretched to each scale, convolved with the
    series and differenced, so that scale 1 already sees the whole wavelet.
    """
    x, psi = mother_wavelet(name)
    step = x[1] - x[0]
    integral = np.conj(np.cumsum(psi) * step)
    out = []
    for s in scales:
        at = (np.arange(s * (x[-1] - x[0]) + 1) / (s * step)).astype(int)
        kernel = integral[at[at < len(integral)]][::-1]
        full = -np.sqrt(s) * np.diff(np.convolve(y, kernel))
        extra = (len(full) - len(y)) / 2
        out.append(full[int(np.floor(extra)) : len(full) - int(np.ceil(extra))] if extra > 0 else full)
    return np.array(out)


# ------------------------------------------------------------------ seasonal-trend decomposition


def _loess(y: np.ndarray, at: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """Local linear smoother of an evenly spaced series, evaluated at positions ``at``."""
    n = len(y)
    pos = np.arange(n, dtype=float)
    width = min(span, n)
    left = np.clip(np.floor(at - (width - 1) / 2).astype(int), 0, n - width)
    idx = left[:, None] + np.arange(width)[None, :]
    dist = np.abs(pos[idx] - at[:, None])
    reach = dist.max(axis=1) + (max(span - n, 0)) / 2.0
    u = dist / reach[:, None]
    w = np.where(u <= 0.999, np.where(u <= 0.001, 1.0, (1 - u**3) ** 3), 0.0) * weights[idx]
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    centre = (w * pos[idx]).sum(axis=1)
    var = (w * (pos[idx] - centre[:, None]) ** 2).sum(axis=1)
    tilt = np.where(np.sqrt(var) > 0.001 * (n - 1), (at - centre) / np.where(var > 0, var, 1.0), 0.0)
    w = w * (1 + tilt[:, None] * (pos[idx] - centre[:, None]))
    return np.where(total[:, 0] > 0, (w * y[idx]).sum(axis=1), y[np.clip(np.round(at).astype(int), 0, n - 1)])


def stl(y: np.ndarray, period: int = 12, seasonal: int = 7, robust: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by LOESS; spans follow the usual rules for the period."""
    y, n = np.asarray(y, float), len(y)
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_span += trend_span % 2 == 0
    low_span = period + (period % 2 == 0)
    inner, outer = (2, 15) if robust else (5, 0)
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    everywhere = np.arange(n, dtype=float)

    def moving(v, k):
        c = np.concatenate([[0.0], np.cumsum(v)])
        return (c[k:] - c[:-k]) / k

    for rnd in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                sub = detrended[p::period]
                at = np.arange(-1, len(sub) + 1, dtype=float)
                cycle[p::period][: len(at)] = _loess(sub, at, seasonal, weights[p::period])
            low = moving(moving(moving(cycle, period), period), 3)
            season = cycle[period : period + n] - _loess(low, everywhere, low_span, np.ones(n))
            trend = _loess(y - season, everywhere, trend_span, weights)
        if rnd < outer:
            rest = np.abs(y - season - trend)
            h = 6 * np.median(rest)
            u = rest / h if h > 0 else np.zeros(n)
            weights = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return trend, season, y - season - trend


# ------------------------------------------------------------------ rings


def cyclic_solve(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve ``lower[i] x[i-1] + diagonal[i] x[i] + upper[i] x[i+1] = right[i]`` around a ring, in time linear in its length.

    The two corners are one rank-one change of a tridiagonal system, so one elimination serves both.
    """
    n = len(diagonal)
    if n < 3:
        system = np.diag(diagonal.astype(float))
        for i in range(n):
            system[i, (i + 1) % n] += upper[i]
            system[i, (i - 1) % n] += lower[i]
        return np.linalg.solve(system, right)
    shift = -diagonal[0]
    d = diagonal.astype(float)
    d[0] -= shift
    d[-1] -= upper[-1] * lower[0] / shift
    corner = np.zeros((n, 1))
    corner[0], corner[-1] = shift, upper[-1]
    x = np.hstack([right, corner])
    for i in range(1, n):
        w = lower[i] / d[i - 1]
        d[i] -= w * upper[i - 1]
        x[i] -= w * x[i - 1]
    x[-1] /= d[-1]
    for i in range(n - 2, -1, -1):
        x[i] = (x[i] - upper[i] * x[i + 1]) / d[i]
    y, z = x[:, :-1], x[:, -1]
    share = lower[0] / shift
    return y - np.outer(z, (y[0] + share * y[-1]) / (1 + z[0] + share * z[-1]))


def periodic_spline(xy: np.ndarray, points: int) -> np.ndarray:
    """Closed cubic spline through ring vertices by chord length, sampled evenly in its parameter.

    The last sample repeats the first.  Rings that already have as many vertices are returned as they are.
    """
    if points <= len(xy) or len(xy) < 3:
        return xy
    closed = np.vstack([xy, xy[:1]])
    h = np.hypot(*np.diff(closed, axis=0).T)
    keep = h > 0
    xy, h = xy[keep], h[keep]
    n = len(xy)
    u = np.concatenate([[0.0], np.cumsum(h)])
    slope = (np.roll(xy, -1, axis=0) - xy) / h[:, None]
    before = np.roll(h, 1)
    bend = cyclic_solve(before, 2 * (before + h), h, 6 * (slope - np.roll(slope, 1, axis=0)))
    at = np.linspace(0, u[-1], points)
    k = np.clip(np.searchsorted(u, at, "right") - 1, 0, n - 1)
    a, b, hk = (u[k + 1] - at)[:, None], (at - u[k])[:, None], h[k][:, None]
    nxt = (k + 1) % n
    return (bend[k] * a**3 + bend[nxt] * b**3) / (6 * hk) + (xy[k] / hk - bend[k] * hk / 6) * a + (xy[nxt] / hk - bend[nxt] * hk / 6) * b


def convex_hull(xy: np.ndarray) -> np.ndarray:
    pts = np.unique(xy, axis=0)

    def half(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def smallest_rectangle(xy: np.ndarray) -> np.ndarray:
    """Corners of the smallest enclosing rectangle: one side lies along a hull edge."""
    hull = convex_hull(xy)
    edges = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2)):
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        p = hull @ turn
        (x0, y0), (x1, y1) = p.min(axis=0), p.max(axis=0)
        if best is None or (x1 - x0) * (y1 - y0) < best[0]:
            best = ((x1 - x0) * (y1 - y0), np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) @ turn.T)
    return best[1]


def ring_arcs(xy: np.ndarray, apart: float = 0.1) -> tuple[np.ndarray, str]:
    """Split ring vertices into four arcs: at rectangle corners, else at sharp bends, else evenly.

    Break vertices lie at least ``apart`` of the perimeter from each other.
    """
    n = len(xy)
    step = np.hypot(*(np.roll(xy, -1, axis=0) - xy).T)
    along, total = np.concatenate([[0.0], np.cumsum(step)[:-1]]), step.sum()

    def spaced(candidates) -> list[int]:
        chosen: list[int] = []
        for c in candidates:
            gaps = [abs(along[c] - along[k]) for k in chosen]
            if len(chosen) < 4 and all(min(g, total - g) >= apart * total for g in gaps):
                chosen.append(int(c))
        return sorted(chosen)

    breaks: list[int] = []
    how = "even"
    if n >= 10:
        try:
            corners = smallest_rectangle(xy)
            breaks, how = spaced([int(np.argmin(np.hypot(*(xy - c).T))) for c in corners]), "rectangle"
        except (ValueError, IndexError, TypeError):
            breaks = []
        if len(breaks) < 4:
            a, b = xy - np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0) - xy
            size = np.hypot(*a.T) * np.hypot(*b.T)
            bend = np.abs(np.divide(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], size, out=np.zeros(n), where=size > 1e-10))
            breaks, how = spaced(np.argsort(-bend, kind="stable")), "curvature"
    if len(breaks) < 4:
        breaks, how = [i * n // 4 for i in range(4)], "even"
    arc = (np.searchsorted(breaks, np.arange(n), "right") - 1) % 4
    return arc, how
