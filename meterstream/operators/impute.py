"""Gap imputation: by an autoregression on differences, and by cubic splines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def autoregression(y: np.ndarray, most: int = 5) -> np.ndarray:
    """Coefficients of the autoregression of the differences, with the order of least information criterion."""
    d = np.diff(y)
    best, chosen = np.inf, np.zeros(0)
    for p in range(most + 1):
        n = len(d) - most
        if n < most + 2:
            break
        target = d[most:]
        x = np.column_stack([d[most - k : len(d) - k] for k in range(1, p + 1)]) if p else np.zeros((n, 0))
        beta = np.linalg.lstsq(x, target, rcond=None)[0] if p else np.zeros(0)
        rss = ((target - x @ beta) ** 2).sum()
        criterion = n * np.log(max(rss / n, 1e-300)) + 2 * p
        if criterion < best - 1e-9:
            best, chosen = criterion, beta
    return chosen


def forecast_gaps(y: np.ndarray, history: int = 500, most: int = 5) -> np.ndarray:
    """Each run of missing values forecast from what is before it, fitted anew for each; the last value where that is too short. Leading ones stay missing."""
    out = y.astype(float).copy()
    k = 0
    while k < len(out):
        if np.isfinite(out[k]):
            k += 1
            continue
        before = out[max(0, k - history) : k]
        before = before[np.isfinite(before)]
        beta = autoregression(before, most) if len(before) > 2 * most + 3 else np.zeros(0)
        known = list(before)
        while k < len(out) and not np.isfinite(y[k]):
            if known:
                d = np.diff(known[-len(beta) - 1 :])[::-1] if len(beta) else np.zeros(0)
                known.append(known[-1] + float(beta @ d))
                out[k] = known[-1]
            k += 1
    return out


def cubic(y: np.ndarray) -> np.ndarray:
    """Missing values within a series from the cubic spline through the known ones whose first two and last two pieces are one (not-a-knot), not below 0; ends are carried on.

    Three known values give their parabola, two their line.
    """
    at = np.flatnonzero(np.isfinite(y)).astype(float)
    n = len(at)
    if n < 3:
        return np.maximum(np.interp(np.arange(len(y)), at, y[at.astype(int)]), 0) if n else y.copy()
    v, h = y[at.astype(int)], np.diff(at)
    x = np.clip(np.arange(len(y)), at[0], at[-1])
    if n == 3:
        spline = np.polyval(np.polyfit(at - at[0], v, 2), x - at[0])
        return np.where(np.isfinite(y), y, np.maximum(spline, 0))
    # second derivatives at the knots; the ends' are led back to their neighbours'
    a, b, c = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    r = 6 * (np.diff(v[1:]) / h[1:] - np.diff(v[:-1]) / h[:-1])
    b[0] += h[0] * (h[0] + h[1]) / h[1]
    c[0] -= h[0] ** 2 / h[1]
    b[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    a[-1] -= h[-1] ** 2 / h[-2]
    for k in range(1, n - 2):
        w = a[k] / b[k - 1]
        b[k] -= w * c[k - 1]
        r[k] -= w * r[k - 1]
    m = np.zeros(n)
    m[n - 2] = r[-1] / b[-1]
    for k in range(n - 4, -1, -1):
        m[k + 1] = (r[k] - c[k] * m[k + 2]) / b[k]
    m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    k = np.clip(np.searchsorted(at, x, side="right") - 1, 0, n - 2)
    s, e = x - at[k], at[k + 1] - x
    spline = (m[k] * e**3 + m[k + 1] * s**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * e + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * s
    return np.where(np.isfinite(y), y, np.maximum(spline, 0))


def imputed(grid: DataFrame, how: str = "forecast", value: str = "diff") -> DataFrame:
    """Grids with ``imputed``, the values where missing ones are filled in, meter by meter."""
    fill = {"forecast": forecast_gaps, "cubic": cubic}[how]
    from .pipeline import by_meter

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        return group.assign(imputed=fill(group[value].to_numpy(float)))[["meter_id", "ts", value, "imputed"]]

    return by_meter(grid.select("meter_id", "ts", value), run, f"ts timestamp, {value} double, imputed double")
