"""The online detector's decision for one reading, as a pure function."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.columns import NOISE

STATUSES = ("invalid", "skipped_duplicate", "skipped_early", "reset", "outage", "post_gap_skipped", "anomaly", "ok", "no_model", "invalid_timestamp")
#: Statuses that leave the state as it was.
REJECTED = frozenset(("invalid", "skipped_duplicate", "skipped_early", "no_model", "invalid_timestamp"))


@dataclass
class Model:
    """A fitted meter: matrices, reference statistics by position and overall, and limits."""

    T: np.ndarray
    Z: np.ndarray
    H: float
    Q: np.ndarray
    P0: np.ndarray
    period: float
    daily: int
    weekly: int
    means: np.ndarray
    stds: np.ndarray
    global_mean: float
    global_std: float
    threshold: float = 3.5
    tolerance_pct: float = 10.0
    most_missing: int | None = None
    schema_version: int = 1


@dataclass
class State:
    x: np.ndarray
    P: np.ndarray
    time: float
    reading: float


@dataclass
class Record:
    status: str
    flag: bool = False
    diff: float | None = None
    z_current: float | None = None
    pred_current: float | None = None
    pred_next: float | None = None
    lower_band_next: float | None = None
    upper_band_next: float | None = None


def position(seconds: float, period: float, daily: int) -> int:
    """Place in the UTC day, half to even, without the fraction of a second."""
    return int(round((int(seconds) % 86400) / period)) % daily


def _spread(model: Model, seconds: float) -> tuple[float, float]:
    p = position(seconds, model.period, model.daily)
    mu, sd = model.means[p], model.stds[p]
    return (mu, sd) if np.isfinite(mu) and np.isfinite(sd) and sd > 0 else (model.global_mean, model.global_std)


def _ahead(model: Model, x: np.ndarray, P: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(n):
        x = model.T @ x
        P = model.T @ P @ model.T.T + model.Q
    return x, P


def _with_next(model: Model, state: State, record: Record) -> Record:
    """The record with the prediction and band for the next slot."""
    x, _ = _ahead(model, state.x, state.P)
    guess = max(float(model.Z @ x), 0.0)
    mu, sd = _spread(model, state.time + model.period)
    record.pred_next = guess
    record.lower_band_next = max(guess - (mu + model.threshold * sd), 0.0)
    record.upper_band_next = guess + mu + model.threshold * sd
    return record


def step(model: Model, state: State, time: float, reading: float | None) -> tuple[State, Record]:
    """State and record after a reading at ``time`` (seconds of UTC); the first rule that fits decides.

    Missing reading: invalid. Not later than the state: duplicate. Sooner than a period less the
    tolerance: early. A fall by the noise or more: reset, which moves the state on without the
    reading. More missing slots than the cap: outage, with fresh uncertainty and the slots counted
    within a week. Any missing slot: the reading after a gap isn't judged. Else its score decides
    between anomaly, which doesn't update, and ok, which does. Sentences about the score are on
    both sides: an unusually small residual is flagged too.
    """
    if reading is None or not np.isfinite(reading):
        return state, Record("invalid")
    delta = time - state.time
    if delta <= 0:
        return state, Record("skipped_duplicate")
    if delta < model.period * (1 - model.tolerance_pct / 100):
        return state, Record("skipped_early")
    n = max(1, round(delta / model.period))
    diff = reading - state.reading
    if -NOISE < diff < 0:
        diff = 0.0
    missing = n - 1
    if diff <= -NOISE:
        x, P = _ahead(model, state.x, state.P, n)
        new = State(x, P, time, reading)
        return new, _with_next(model, new, Record("reset"))
    if missing > (model.most_missing if model.most_missing is not None else model.weekly):
        x, _ = _ahead(model, state.x, state.P, missing % model.weekly + 1)
        new = State(x, model.P0.copy(), time, reading)
        return new, _with_next(model, new, Record("outage", diff=diff))
    x, P = _ahead(model, state.x, state.P, n)
    raw = float(model.Z @ x)
    if missing:
        new = State(x, P, time, reading)
        return new, _with_next(model, new, Record("post_gap_skipped", diff=diff))
    mu, sd = _spread(model, time)
    z = (abs(diff - raw) - mu) / sd if sd > 0 else 0.0
    record = Record("anomaly" if abs(z) > model.threshold else "ok", abs(z) > model.threshold, diff, z, max(raw, 0.0))
    if record.status == "ok":
        PZ = P @ model.Z
        K = PZ / (PZ @ model.Z + model.H)
        x = x + K * (diff - raw)
        A = np.eye(len(x)) - np.outer(K, model.Z)
        P = A @ P @ A.T + model.H * np.outer(K, K)
        P = (P + P.T) / 2
    new = State(x, P, time, reading)
    return new, _with_next(model, new, record)


@dataclass
class Replay:
    """A detector that keeps its state between readings."""

    model: Model
    state: State
    counts: dict[str, int] = field(default_factory=dict)

    def feed(self, time: float, reading: float | None) -> Record:
        self.state, record = step(self.model, self.state, time, reading)
        self.counts[record.status] = self.counts.get(record.status, 0) + 1
        return record
