"""Seasonal-trend decomposition by local regression, and strengths drawn from it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def loess(y: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Locally linear fit with tricube weights over the ``width`` nearest of equally spaced points; a width beyond the series flattens the weights."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else at
    q = min(width, n)
    lo = np.clip(np.ceil(at - q / 2).astype(int), 0, n - q)
    idx = lo[:, None] + np.arange(q)
    d = np.abs(idx - at[:, None])
    reach = np.maximum(d.max(axis=1), 1e-12)[:, None] + max(0, (width - n) // 2)
    w = np.where(d <= 0.001 * reach, 1.0, np.where(d <= 0.999 * reach, (1 - (d / reach) ** 3) ** 3, 0.0))
    s = w.sum(1)
    s[s == 0] = 1
    x = idx - at[:, None]
    mx, my = (w * x).sum(1) / s, (w * y[idx]).sum(1) / s
    sxx = (w * (x - mx[:, None]) ** 2).sum(1)
    sxy = (w * (x - mx[:, None]) * (y[idx] - my[:, None])).sum(1)
    return my - np.where(sxx > 1e-12, sxy / np.maximum(sxx, 1e-12), 0) * mx


@lru_cache(maxsize=8)
def _cycle_smoother(n: int, width: int) -> np.ndarray:
    """The smoother of a series of ``n`` as a matrix, which gives one value more at either end."""
    spots = np.arange(-1, n + 1, dtype=float)
    return np.column_stack([loess(unit, width, spots) for unit in np.eye(n)])


def _mean(y: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[n:] - total[:-n]) / n


def stl(y: np.ndarray, period: int, seasonal: int = 7, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and remainder."""
    n = len(y)
    width = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    width += 1 - width % 2
    low = period + 1 + period % 2
    trend, season = np.zeros(n), np.zeros(n)
    longer = (n - 1) % period + 1  # the first places of a cycle occur once more than the others
    for _ in range(rounds):
        free = y - trend
        cycle = np.zeros(n + 2 * period)
        for first, last in ((0, longer), (longer, period)):
            if last > first:
                rows = len(range(first, n, period))
                own = free[np.arange(rows)[:, None] * period + np.arange(first, last)]
                spots = np.arange(-1, rows + 1, dtype=float)
                smooth = _cycle_smoother(rows, seasonal) @ own if rows <= 4000 else np.column_stack([loess(part, seasonal, spots) for part in own.T])  # the matrix of more would not fit
                cycle[np.arange(rows + 2)[:, None] * period + np.arange(first, last)] = smooth
        passed = loess(_mean(_mean(_mean(cycle, period), period), 3), low)
        season = cycle[period : period + n] - passed[:n]
        trend = loess(y - season, width)
    return trend, season, y - season - trend


def several(y: np.ndarray, periods: list[int], sweeps: int = 2) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The season of each period, shortest first, and what is left without trend and all of them.

    Several seasons are taken out in turn: each is drawn from the series without the others, with a
    window that is wider for longer periods, and the turns are repeated.
    """
    if len(periods) == 1:
        _, season, rest = stl(y, periods[0])
        return {periods[0]: season}, rest
    found = {p: np.zeros(len(y)) for p in periods}
    left = y
    for _ in range(sweeps):
        for k, p in enumerate(periods):
            own = left + found[p]
            trend, found[p], _ = stl(own, p, 11 + 4 * k)
            left = own - found[p]
    return found, left - trend


def strength(season: np.ndarray, rest: np.ndarray) -> float:
    """How much of the variance without trend the season explains, from 0 to 1."""
    whole = np.var(season + rest)
    return float(max(0.0, 1 - np.var(rest) / whole)) if whole > 0 else 0.0


def diagnostics(y: np.ndarray, daily: int, weekly: int, longest: int = 20_000) -> dict[str, float]:
    """Seasonal strengths and the remainder's squared variation against typical positive values; NaN where a series is too short.

    Both seasons are taken out together, the weekly one unless the series is longer than
    ``longest``, and both strengths are measured against what is left of both. Missing values are
    filled in linearly for the decomposition alone; the variation is that of observed rows
    (deviation of a sample), over the mean or median of those above 0.
    """
    out = {"f_s_daily": np.nan, "f_s_weekly": np.nan, "residual_cv2": np.nan, "residual_cv2_robust": np.nan}
    good = np.isfinite(y)
    periods = [p for p in dict.fromkeys((daily, weekly)) if p >= 2 and len(y) >= 2 * p + 1 and (p == daily or len(y) <= longest)]
    if not periods:
        return out
    full = np.interp(np.arange(len(y)), np.flatnonzero(good), y[good]) if good.any() else np.zeros(len(y))
    seasons, rest = several(full, sorted(periods))
    for name, p in (("f_s_weekly", weekly), ("f_s_daily", daily)):
        if p in seasons:
            out[name] = strength(seasons[p], rest)
    left, some = rest[good], y[good & (y > 0)]
    if len(left) > 1 and len(some):
        out["residual_cv2"] = float((left.std(ddof=1) / some.mean()) ** 2)
        out["residual_cv2_robust"] = float((1.4826 * np.median(np.abs(left - np.median(left))) / np.median(some)) ** 2)
    return out
