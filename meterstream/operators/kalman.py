"""Structural models of one meter as pure numpy: matrices, filters, likelihood, fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Seasonal variants of the model: whether there are daily dummies, and the Fourier blocks (steps, harmonics).
VARIANTS = {"level": (False, ()), "daily": (True, ()), "daily_weekly_fourier": (True, ("weekly",)), "fourier": (False, ("weekly", "daily"))}


@dataclass
class System:
    """State space: ``x' = T x + noise(Q)``, ``y = Z x + noise(H)``."""

    T: np.ndarray
    Z: np.ndarray
    H: float
    Q: np.ndarray


def system(theta: np.ndarray, daily: int, weekly: int, variant: str = "fourier", harmonics: int = 2) -> System:
    """Matrices for variances in the order irregular, level, [dummies], Fourier blocks."""
    dummies, blocks = VARIANTS[variant]
    parts, loads, noise = [np.eye(1)], [[1.0]], [theta[1]]
    at = 2
    if dummies:
        m = max(1, daily - 1)
        s = np.eye(m, k=-1)
        s[0] = -1
        parts.append(s)
        loads.append([1.0] + [0.0] * (m - 1))
        noise += [theta[at]] + [0.0] * (m - 1)
        at += 1
    for name in blocks:
        steps = weekly if name == "weekly" else daily
        for j in range(1, harmonics + 1):
            w = 2 * np.pi * j / steps
            parts.append(np.array([[np.cos(w), np.sin(w)], [-np.sin(w), np.cos(w)]]))
            loads.append([1.0, 0.0])
            noise += [theta[at]] * 2
        at += 1
    n = sum(len(p) for p in parts)
    T = np.zeros((n, n))
    k = 0
    for p in parts:
        T[k : k + len(p), k : k + len(p)] = p
        k += len(p)
    return System(T, np.concatenate(loads), float(theta[0]), np.diag(noise))


def n_theta(variant: str) -> int:
    dummies, blocks = VARIANTS[variant]
    return 2 + dummies + len(blocks)


@dataclass
class Run:
    """Predictions, innovations and their variances, the last state, and the log likelihood behind the burn-in."""

    predicted: np.ndarray
    innovation: np.ndarray
    variance: np.ndarray
    x: np.ndarray
    P: np.ndarray
    llf: float


def run_filter(sys: System, y: np.ndarray, x: np.ndarray | None = None, P: np.ndarray | None = None, *, mask=None, burn: int | None = None, lead: bool = False) -> Run:
    """One-step predictions over ``y``; missing values, and those for which ``mask(k, value, prediction)`` says so, don't update the state (Joseph form).

    A given state is what is expected at the first value, before it is seen; with ``lead``, at the
    one before it. Without one, the first state is unknown.
    """
    n = len(sys.Z)
    burn = (n if x is None else 0) if burn is None else burn
    x = np.zeros(n) if x is None else x.copy()
    P = np.eye(n) * 1e6 if P is None else P.copy()
    T, Z, H, Q, I = sys.T, sys.Z, sys.H, sys.Q, np.eye(n)
    predicted, innovation, variance = np.empty(len(y)), np.full(len(y), np.nan), np.empty(len(y))
    llf = 0.0
    for k, value in enumerate(y):
        if k or lead:
            x = T @ x
            P = T @ P @ T.T + Q
        predicted[k] = Z @ x
        PZ = P @ Z
        S = Z @ PZ + H
        variance[k] = S
        if np.isfinite(value):
            v = value - predicted[k]
            innovation[k] = v
            if k >= burn:
                llf -= 0.5 * (np.log(2 * np.pi * S) + v * v / S)
            if mask is None or not mask(k, value, predicted[k]):
                K = PZ / S
                x = x + K * v
                A = I - np.outer(K, Z)
                P = A @ P @ A.T + H * np.outer(K, K)
                P = (P + P.T) / 2
    return Run(predicted, innovation, variance, x, P, llf)


def likelihoods(thetas: np.ndarray, y: np.ndarray, daily: int, weekly: int, variant: str = "fourier", x: np.ndarray | None = None, P: np.ndarray | None = None) -> np.ndarray:
    """Log likelihoods of several variance vectors in one pass over ``y``; each as in ``run_filter``.

    Levels and Fourier blocks only turn from step to step, and their noise is alike in all
    directions. So the state is followed in coordinates that turn with it: there it stands still,
    and what turns is the load. Other variants take the matrices as they are.
    """
    sys = [system(t, daily, weekly, variant) for t in thetas]
    T, Z, m = sys[0].T, sys[0].Z, len(sys)
    n = len(Z)
    burn = n if x is None else 0
    H, Q = np.array([s.H for s in sys]), np.stack([s.Q for s in sys])
    x = np.zeros((m, n)) if x is None else np.tile(x, (m, 1)).astype(float)
    P = np.tile(np.eye(n) * 1e6 if P is None else P, (m, 1, 1)).astype(float)
    turning = not VARIANTS[variant][0]
    loads = np.tile(Z, (len(y), 1))
    if turning:
        k = np.arange(len(y))
        for at in range(1, n, 2):  # a block's first row holds the cosine and sine of its step
            angle = k * np.arctan2(T[at, at + 1], T[at, at])
            loads[:, at], loads[:, at + 1] = np.cos(angle), np.sin(angle)
    variances, innovations = np.ones((len(y), m)), np.zeros((len(y), m))
    known = np.flatnonzero(np.isfinite(y))
    wide, guarded, seen = np.empty((m, n, n)), 4 * max(n, daily), 0
    with np.errstate(all="ignore"):
        for k in known.tolist() if turning else range(len(y)):
            if turning:
                P += Q if k - seen == 1 else Q * (k - seen)  # noise of all steps since the last value
                seen = k
            elif k:
                x = x @ T.T
                P = T @ P @ T.T + Q
            if y[k] != y[k]:
                continue
            load = loads[k]
            PZ = (P.reshape(m * n, n) @ load).reshape(m, n)
            S = PZ @ load + H
            v = y[k] - x @ load
            variances[k], innovations[k] = S, v
            K = PZ / S[:, None]
            x += K * v[:, None]
            P -= np.multiply(K[:, :, None], PZ[:, None, :], out=wide)
            if k < guarded:  # as long as the state is all but unknown, what rounding has left behind is taken out
                left = (P.reshape(m * n, n) @ load).reshape(m, n) - H[:, None] * K
                P -= np.multiply(left[:, :, None], K[:, None, :], out=wide)
        counted = known[known >= burn]
        S, v = variances[counted], innovations[counted]
        return -0.5 * (np.log(2 * np.pi * S) + v * v / S).sum(axis=0)


def fit(y: np.ndarray, daily: int, weekly: int, variant: str = "fourier", *, start: np.ndarray | None = None, x: np.ndarray | None = None, P: np.ndarray | None = None, most: int = 200) -> tuple[np.ndarray, float, bool]:
    """Variances of largest likelihood by a quasi-Newton search over their logarithms; with the log likelihood and whether it settled.

    A gradient's differences, and the steps tried along a direction, are each one pass. The search
    ends when neither the direction nor plain descent gains any more, or after ``most`` steps.
    """
    spread = np.nanvar(y) if np.isfinite(y).any() else 0.0
    if not spread > 0:
        spread = 1e-6
    d = n_theta(variant)
    p = np.log(spread * np.array([0.5, 0.05] + [0.005] * (d - 2))) if start is None else np.log(np.maximum(start, 1e-12))

    def losses(points: np.ndarray) -> np.ndarray:
        found = -likelihoods(np.exp(np.clip(points, -35, 35)), y, daily, weekly, variant, x, P)
        return np.where(np.isfinite(found), found, 1e300)

    shift = 1e-2 * np.eye(d)  # wide enough to stand above the rounding of an unknown first state
    steps = 2.0 ** np.arange(2, -7, -1)
    curve, before, settled = np.eye(d), None, False
    best = float(losses(p[None])[0])
    for _ in range(most):
        around = losses(np.vstack([p + shift, p - shift]))
        slope = (around[:d] - around[d:]) / 2e-2
        if before is not None:  # the inverse curvature learns from the last step
            s, g = before[0], slope - before[1]
            if (rho := s @ g) > 1e-10:
                if (curve == np.eye(d)).all():
                    curve = curve * rho / (g @ g)
                left = np.eye(d) - np.outer(s, g) / rho
                curve = left @ curve @ left.T + np.outer(s, s) / rho
        moved = False
        for direction in (-curve @ slope, -slope):
            size = np.abs(direction).max()
            if not size > 0:
                continue
            direction = direction * min(1.0, 3.0 / size)  # no variance changes by more than some ten times at once
            tried = p + steps[:, None] * direction
            found = losses(tried)
            k = int(found.argmin())
            if found[k] < best - 1e-7 * (1 + abs(best)):
                before, p, best, moved = (tried[k] - p, slope), np.clip(tried[k], -35, 35), float(found[k]), True
                break
            curve = np.eye(d)
        if not moved:
            settled = True
            break
    return np.exp(p), -best, settled


def _lagged(lags: list[int]) -> np.ndarray:
    """Moves each value a place on and puts the mean of those at the lags in front."""
    A = np.eye(max(lags), k=-1)
    A[0] = 0
    A[0, [k - 1 for k in lags]] = 1 / len(lags)
    return A


def regular(A: np.ndarray, most: float = 1.0) -> np.ndarray:
    """A transition whose eigenvalues are no larger than ``most``: shrunk as a whole if one is."""
    largest = float(np.abs(np.linalg.eigvals(A)).max()) if len(A) else 0.0
    return A * (most / largest) if largest > most * (1 + 1e-9) else A


def seasonal_lag_filter(y: np.ndarray, lags: list[int], q: float, r: float) -> Run:
    """A filter whose state holds the latest values at some lags; the first value fills it. The prediction is their mean, and values that are missing don't update."""
    n = max(lags)
    state, P = np.full(n, y[0]), np.eye(n) * r
    A = regular(_lagged(lags))
    Q = np.zeros((n, n))
    Q[0, 0] = q
    Z = np.eye(n)[0]
    return run_filter(System(A, Z, r, Q), y, state, P, lead=True)


def recursive_transition(states: np.ndarray, forget: float = 0.9999, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition matrix by weighted recursive least squares, row by row over successive states, the residuals' covariance, and the mean of the rows' own."""
    n = states.shape[1]
    A = np.zeros((n, n)) if start is None else start.copy()
    P = np.stack([np.eye(n) * 1000.0] * n)
    left = []
    for before, after in zip(states, states[1:]):
        left.append(after - A @ before)
        for k in range(n):
            g = P[k] @ before / (before @ P[k] @ before + 1 / forget)
            A[k] += g * (after[k] - A[k] @ before)
            P[k] = (P[k] - np.outer(g, before) @ P[k]) / forget
    Q = np.cov(np.array(left).T).reshape(n, n) if len(left) > 1 else np.zeros((n, n))
    return A, Q + 1e-9 * np.eye(n), P.mean(axis=0)


def unstable(A: np.ndarray) -> int:
    """Eigenvalues of modulus above 1."""
    return int((np.abs(np.linalg.eigvals(A)) > 1 + 1e-6).sum())
