"""Meter by meter: fit and gate, evaluate, filter; one grouped job each, whose failures are rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming.detector import dump_model, load_model
from ..streaming.step import Model, State, position, step
from . import decompose, detectors, kalman
from .grid import filled_frame, marked
from .metrics import GATES

FITTED = "status string, stage string, error string, reasons string, period double, daily_steps int, weekly_steps int, k_positions int, theta array<double>, llf double, converged boolean, fill_pct double, f_s double, f_s_weekly double, mase double, mase_seasonal double, global_mean double, global_std double, signature string, warm_started boolean, n_fit int, n_reference int, seconds double, model string"


def _key(df: DataFrame) -> str:
    return df.schema["meter_id"].dataType.simpleString()


def _names(schema: str) -> list[str]:
    return [x.strip().split()[0] for x in schema.split(",")]


def guarded(run: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A grouped function that turns an exception into a row with the ``error`` and, where there is such a column, ``status`` failed."""

    def safe(group: pd.DataFrame) -> pd.DataFrame:
        try:
            out = run(group).reindex(columns=columns).astype(object)
            return out.where(out.notna(), None)
        except Exception as problem:  # noqa: BLE001 - one meter must not end the job
            row = dict.fromkeys(columns)
            row |= {"meter_id": group["meter_id"].iloc[0], "status": "failed", "error": f"{type(problem).__name__}: {problem}"}
            return pd.DataFrame([{k: row[k] for k in columns}], columns=columns)

    return safe


def by_meter(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on each meter's rows; a meter on which it fails gives one row with the ``error`` and nulls. ``schema`` comes without ``meter_id``."""
    schema = schema if "error string" in schema else f"{schema}, error string"
    return _dealt(rows).groupBy("meter_id").applyInPandas(guarded(run, ["meter_id", *_names(schema)]), f"meter_id {_key(rows)}, {schema}")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by meter to as many tasks as the session shuffles to.

    Left to itself, Spark would put meters together by their bytes, which are few for what a fit
    of them takes; the grouping that follows needs no other shuffle.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "meter_id")


def with_models(rows: DataFrame, models: DataFrame, run: Callable[[pd.DataFrame, pd.Series | None], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on each meter's rows and its row of ``models`` (null without one), guarded like ``by_meter``.

    Both sides are shuffled by meter once; a join would carry a model along with every row.
    """
    schema = schema if "error string" in schema else f"{schema}, error string"
    columns = ["meter_id", *_names(schema)]

    def both(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=columns)
        return guarded(lambda g: run(g, own.iloc[0] if len(own) else None), columns)(group)

    kind = _key(rows)
    keyed = models.withColumn("meter_id", F.col("meter_id").cast(kind))
    return _dealt(rows).groupBy("meter_id").cogroup(_dealt(keyed).groupBy("meter_id")).applyInPandas(both, f"meter_id {kind}, {schema}")


def signature(period: float, daily: int, weekly: int, variant: str) -> str:
    """What two fits must share for one to start from the other."""
    return json.dumps({"daily": daily, "period": round(period), "variant": variant, "weekly": weekly}, sort_keys=True)


def pooled(residuals: np.ndarray, positions: np.ndarray, steps: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation around each position (0 of a single value, NaN of none)."""
    means, stds = np.full(steps, np.nan), np.full(steps, np.nan)
    by = [residuals[(positions == p) & np.isfinite(residuals)] for p in range(steps)]
    for p in range(steps):
        own = np.concatenate([by[(p + o) % steps] for o in range(-k, k + 1)])
        if len(own):
            means[p], stds[p] = own.mean(), own.std(ddof=1) if len(own) > 1 else 0.0
    return means, stds


def scaled_error(actual: np.ndarray, predicted: np.ndarray, trained: np.ndarray, lag: int) -> float:
    """Mean absolute error over that of repeating the value ``lag`` steps before on the training rows; NaN without rows or spread."""
    errors = np.abs(actual - predicted)
    naive = np.abs(trained[lag:] - trained[:-lag]) if len(trained) > lag else np.zeros(0)
    errors, naive = errors[np.isfinite(errors)], naive[np.isfinite(naive)]
    return float(errors.mean() / naive.mean()) if len(errors) and len(naive) and naive.mean() > 0 else np.nan


def fit_frame(group: pd.DataFrame, before: tuple[str, State] | None = None, *, gate: str | None = None, variant: str = "fourier", holdout_days: float = 0, tolerance_pct: float = 10.0, threshold: float = 3.5, k_hours: float = 2.0, least_k: int = 2, scaled_by: str = "mase_seasonal", checked: bool = True, most: int = 200) -> tuple[dict, Model | None, State | None]:
    """One meter's model row from its readings, and the model with its starting state where there is one.

    Grid, gate before the fit, fit, reference residuals, gate after it. ``before`` is the signature
    and state of an earlier fit: if the signature is unchanged, its state is what the new fit's
    first value is expected from, and the gate is that of refits (unless ``gate`` names one).
    """
    began = time.monotonic()
    grid = filled_frame(group, tolerance_pct)
    if len(grid) < 2:
        raise ValueError("the series has no usable period or too few rows")
    y = grid["diff"].to_numpy(float)
    stamps = grid["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6
    period = float(grid["period"].iloc[0])
    daily = int(round(86400 / period))
    weekly, k = 7 * daily, max(least_k, round(k_hours * daily / 24))
    out = {"meter_id": group["meter_id"].iloc[0], "period": period, "daily_steps": daily, "weekly_steps": weekly, "k_positions": k, "signature": signature(period, daily, weekly, variant)}
    if daily < 2:
        raise ValueError("the period is too long: a day has fewer than two steps")
    reference = stamps >= stamps[-1] - holdout_days * 86400 if holdout_days else np.ones(len(y), bool)
    train = ~reference if holdout_days else reference
    if train.sum() < 2 or reference.sum() < 2:
        raise ValueError("too few rows to fit on or to refer to")
    out |= {"n_fit": int(train.sum()), "n_reference": int(reference.sum())}
    start = before[1] if before is not None and before[0] == out["signature"] else None
    out["warm_started"] = start is not None
    fill_most, strength_least, error_most = GATES[gate or ("initial" if start is None else "retrain")]

    def rejected(stage: str, reasons: list[str]) -> tuple[dict, None, None]:
        return out | {"status": "rejected", "stage": stage, "reasons": ",".join(reasons), "seconds": time.monotonic() - began}, None, None

    out["fill_pct"] = 100 * float(grid["reading"].isna().mean())
    found = decompose.diagnostics(y, daily, weekly) if np.isfinite(y).sum() >= 2 * daily else {"f_s_daily": np.nan, "f_s_weekly": np.nan}
    out |= {"f_s": found["f_s_daily"], "f_s_weekly": found["f_s_weekly"]}
    reasons = [name for name, good in (("fill", out["fill_pct"] < fill_most), ("seasonality", out["f_s"] > strength_least)) if not good]
    if checked and reasons:
        return rejected("pre_train", reasons)
    x, P = (start.x, start.P) if start is not None else (None, None)
    theta, llf, settled = kalman.fit(y[train], daily, weekly, variant, x=x, P=P, most=most)
    out |= {"theta": theta, "llf": llf, "converged": settled}
    sys = kalman.system(theta, daily, weekly, variant)
    end = fitted = kalman.run_filter(sys, y[train], x, P)
    if holdout_days:
        end = kalman.run_filter(sys, y[reference], fitted.x, fitted.P)
    guess, actual = np.maximum(end.predicted, 0), y[reference]
    out |= {"mase": scaled_error(actual, guess, y[train], 1), "mase_seasonal": scaled_error(actual, guess, y[train], daily)}
    if checked and not out[scaled_by] < error_most:
        return rejected("post_train", ["mase"])
    residual = np.abs(actual - guess)
    means, stds = pooled(residual, np.array([position(t, period, daily) for t in stamps[reference]]), daily, k)
    good = residual[np.isfinite(residual)]
    out |= {"global_mean": float(good.mean()) if len(good) else 0.0, "global_std": float(good.std(ddof=1)) if len(good) > 1 else 0.0}
    known = grid["reading"].to_numpy(float)[reference]
    if not np.isfinite(known).any():
        raise ValueError("the reference has no reading")
    model = Model(sys.T, sys.Z, sys.H, sys.Q, end.P, period, daily, weekly, means, stds, out["global_mean"], out["global_std"], threshold, tolerance_pct)
    state = State(end.x, end.P, float(stamps[-1]), float(known[np.isfinite(known)][-1]))
    return out | {"status": "success", "model": dump_model(model, state), "seconds": time.monotonic() - began}, model, state


def fit_meters(readings: DataFrame, *, previous: DataFrame | None = None, **options) -> DataFrame:
    """A model row for each meter: grid, gate before the fit, fit, reference residuals, gate after it, model and state.

    ``previous`` holds earlier rows; a meter whose signature is unchanged starts from the state
    that is kept with its model. Rejected meters say at which stage and why and have no model.
    ``options`` are those of ``fit_frame``.
    """
    def run(group: pd.DataFrame, own: pd.Series | None = None) -> pd.DataFrame:
        before = (own["signature"], load_model(own["model"])[1]) if own is not None and isinstance(own["model"], str) else None
        return pd.DataFrame([fit_frame(group, before, **options)[0]])

    if previous is None:
        return by_meter(marked(readings), run, FITTED)
    return with_models(marked(readings), previous.select("meter_id", "signature", "model"), run, FITTED)


SCORED = "ts timestamp, actual double, predicted double, residual double, position int, is_anomaly double, segment string, status string, converged boolean, error string"


def evaluate_meters(rows: DataFrame, *, variant: str = "fourier", masked: bool = True, reference: str = "second", threshold: float = 3.5, most: int = 200) -> DataFrame:
    """Scored rows of each meter from its segments train, second and predict: two fits, the second from where the first ended, then predictions that flagged values don't update.

    Rows have ``segment, period, diff, is_anomaly``. Returned are the second segment's reference
    residuals and the predictions; statistics and metrics follow as table operations. With
    ``reference="self"`` the predictions' own residuals are the reference, and only they are returned.
    ``converged`` tells of both fits.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        period = float(group["period"].iloc[0])
        daily = int(round(86400 / period))
        weekly = 7 * daily
        part = {name: group[group["segment"] == name] for name in ("train", "second", "predict")}
        y = {name: p["diff"].to_numpy(float) for name, p in part.items()}
        theta, _, settled = kalman.fit(y["train"], daily, weekly, variant, most=most)
        first = kalman.run_filter(kalman.system(theta, daily, weekly, variant), y["train"])
        theta, _, settled_too = kalman.fit(y["second"], daily, weekly, variant, x=first.x, P=first.P, most=most)
        sys = kalman.system(theta, daily, weekly, variant)
        second = kalman.run_filter(sys, y["second"], first.x, first.P)
        known = np.abs(y["second"] - np.maximum(second.predicted, 0))
        mu, sd = np.nanmean(known), np.nanstd(known, ddof=1)
        mask = (lambda k, value, guess: sd > 0 and abs((abs(value - guess) - mu) / sd) > threshold) if masked and reference == "second" else None
        last = kalman.run_filter(sys, y["predict"], second.x, second.P, mask=mask)
        frames = []
        for name, found in (("second", second), ("predict", last)):
            if name == "second" and reference == "self":
                continue
            guess = np.maximum(found.predicted, 0)
            at = part[name]["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6
            frames.append(pd.DataFrame({"meter_id": part[name]["meter_id"], "ts": part[name]["ts"], "actual": y[name], "predicted": guess, "residual": np.abs(y[name] - guess), "position": [position(t, period, daily) for t in at], "is_anomaly": part[name]["is_anomaly"], "segment": name, "status": "success", "converged": settled and settled_too}))
        return pd.concat(frames)

    return by_meter(rows, run, SCORED)


def local_level(rows: DataFrame, *, q: float, r: float, p0: float, threshold: float | None = None) -> DataFrame:
    """One-step predictions of a scalar random walk in noise, by one pass over each meter's rows in time.

    The state starts at the first value (0 if it is missing), which has no row. With
    ``threshold``, values whose innovation is more than that many of its deviations away don't
    update. ``magnitude`` is the innovation over its deviation.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        y = group["diff"].to_numpy(float).tolist()
        x, p = y[0] if y[0] == y[0] else 0.0, p0
        out = []
        for value in y[1:]:
            s = p + q + r
            out.append((x, s, abs(value - x) / s**0.5))
            if value == value and (threshold is None or abs(value - x) <= threshold * s**0.5):
                x, p = x + (p + q) / s * (value - x), (p + q) * r / s
            else:
                p = p + q
        x, s, size = zip(*out) if out else ((), (), ())
        return pd.DataFrame({"meter_id": group["meter_id"].iloc[1:], "ts": group["ts"].iloc[1:], "actual": y[1:], "predicted": np.maximum(np.array(x, float), 0), "variance": s, "magnitude": size})

    return by_meter(rows.select("meter_id", F.col("ts").cast("timestamp").alias("ts"), F.col("diff").cast("double").alias("diff")), run, "ts timestamp, actual double, predicted double, variance double, magnitude double")


def seasonal_strength(rows: DataFrame, daily: int, weekly: int) -> DataFrame:
    """Strengths of each meter's seasons and the variation that is left."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = decompose.diagnostics(group.sort_values("ts")["diff"].to_numpy(float), daily, weekly)
        return pd.DataFrame([{"meter_id": group["meter_id"].iloc[0]} | found])

    return by_meter(rows.select("meter_id", "ts", "diff"), run, "f_s_daily double, f_s_weekly double, residual_cv2 double, residual_cv2_robust double")


def harmonics(rows: DataFrame) -> DataFrame:
    """Sine and cosine of the time since the epoch, by day and by week."""
    t = F.unix_timestamp("ts")
    return rows.withColumns({f"{f}_{name}": g(2 * np.pi * t / length) for name, length in (("day", 86400), ("week", 604800)) for f, g in (("sin", F.sin), ("cos", F.cos))})


def isolation(rows: DataFrame, contamination: float | None = 0.01) -> DataFrame:
    """Isolation scores of each meter's rows, flagged above the quantile that leaves that share; without one, above a score of 0.5, the average path."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["diff"].notna()]
        s = detectors.isolation_scores(group[["diff", "sin_day", "cos_day", "sin_week", "cos_week"]].to_numpy(float)) if len(group) else np.zeros(0)
        cut = 0.5 if contamination is None else np.quantile(s, 1 - contamination) if len(s) else 0
        return pd.DataFrame({"meter_id": group["meter_id"], "ts": group["ts"], "diff": group["diff"], "score": s, "flagged": s > cut})

    return by_meter(harmonics(rows.select("meter_id", "ts", "diff")), run, "ts timestamp, diff double, score double, flagged boolean")


#: Features of the count model. The mean is of the three values before, so that the value itself is not among them.
COUNT_FEATURES = ["sin_day", "cos_day", "sin_week", "cos_week", "lag_1", "lag_2", "mean_3"]


def _count_features(rows: DataFrame) -> DataFrame:
    each = Window.partitionBy("meter_id").orderBy("ts")
    return harmonics(rows.select("meter_id", "ts", "diff")).withColumns({"lag_1": F.lag("diff", 1).over(each), "lag_2": F.lag("diff", 2).over(each), "mean_3": F.avg("diff").over(each.rowsBetween(-3, -1))}).dropna()


def _count_scores(y: np.ndarray, x: np.ndarray, own: dict) -> tuple[np.ndarray, np.ndarray]:
    mu = np.exp(np.clip(np.column_stack([np.ones(len(x)), (x - own["mean"]) / own["sd"]]) @ own["beta"], -30, 30))
    return mu, -np.log(np.maximum(detectors.negative_binomial_pmf(y, mu, max(own["dispersion"], 1e-3)), 1e-300))


def count_models(rows: DataFrame, *, quantile: float = 0.99, least_rows: int = 50, scale: float = 1.0) -> DataFrame:
    """A negative-binomial model of each meter's increments as counts, with the threshold that its scores (-log of the probability) are below but for ``1 - quantile`` of them.

    Increments are divided by ``scale`` and rounded to be counted: set it to the least step of the
    meter. Meters with fewer than ``least_rows`` rows have status ``too_short`` and no model.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = {"meter_id": group["meter_id"].iloc[0], "n": len(group), "scale": scale, "status": "too_short"}
        if len(group) >= least_rows:
            y, x = np.round(group["diff"].to_numpy(float) / scale), group[COUNT_FEATURES].to_numpy(float)
            own = {"mean": x.mean(0), "sd": np.maximum(x.std(0), 1e-9)}
            own["beta"], _, own["dispersion"] = detectors.negative_binomial(np.column_stack([np.ones(len(x)), (x - own["mean"]) / own["sd"]]), y)
            out |= own | {"status": "success", "threshold": float(np.quantile(_count_scores(y, x, own)[1], quantile))}
        return pd.DataFrame([out])

    return by_meter(_count_features(rows), run, "status string, n long, scale double, mean array<double>, sd array<double>, beta array<double>, dispersion double, threshold double")


def count_scores(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows scored by stored count models: expected count, score and whether it is above the model's threshold. Meters without a model give none."""
    names = ["scale", "mean", "sd", "beta", "dispersion", "threshold"]

    def run(group: pd.DataFrame, own: pd.Series | None) -> pd.DataFrame:
        if own is None:
            return pd.DataFrame(columns=["meter_id"])
        model = {k: np.array(v, float) if k in ("mean", "sd", "beta") else float(v) for k, v in own[names].items()}
        mu, s = _count_scores(np.round(group["diff"].to_numpy(float) / model["scale"]), group[COUNT_FEATURES].to_numpy(float), model)
        return pd.DataFrame({"meter_id": group["meter_id"], "ts": group["ts"], "diff": group["diff"], "expected": mu, "score": s, "flagged": s > model["threshold"]})

    return with_models(_count_features(rows), models.where("status = 'success'").select("meter_id", *names), run, "ts timestamp, diff double, expected double, score double, flagged boolean")


def count_model(rows: DataFrame, **options) -> DataFrame:
    """Each meter's rows scored by the count model that is fitted to them."""
    return count_scores(rows, count_models(rows, **options))


def recurrent_features(rows: DataFrame) -> DataFrame:
    """Increment (missing ones from before, then 0), capped hours since the row before, and hour and weekday on a circle."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    value = F.coalesce(F.last("diff", ignorenulls=True).over(each.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    hours = F.coalesce((F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(each)) / 3600, F.lit(0.0))
    hour, day = F.hour("ts") + F.minute("ts") / 60, F.weekday("ts")
    circle = {f"{f}_{n}": g(2 * np.pi * v / m) for n, v, m in (("hour", hour, 24), ("dow", day, 7)) for f, g in (("sin", F.sin), ("cos", F.cos))}
    return rows.select("meter_id", "ts", "diff", value.alias("value"), (F.least(F.greatest(hours, F.lit(0.0)), F.lit(24.0)) / 24).alias("gap"), *(v.alias(k) for k, v in circle.items()))


def recurrent(rows: DataFrame, *, width: int = 24, share: float = 0.7, hidden: int = 32, epochs: int = 10, last_inside: bool = False, threshold: float | None = 3.5) -> DataFrame:
    """A recurrent network for each meter, trained on the first ``share`` of its rows and rolled over the rest.

    Values are scaled by the training rows'. With ``threshold``, a value that is missing or whose
    residual is too many deviations of the training residuals away is replaced by its prediction
    for the steps after it; only windows behind such a value are predicted one by one.
    Predictions aren't below 0. Meters too short for two windows give no rows.
    """
    names = ["value", "gap", "sin_hour", "cos_hour", "sin_dow", "cos_dow"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        columns = ["meter_id", "ts", "actual", "predicted", "residual", "flagged"]
        x = group[names].to_numpy(float)
        cut = int(share * len(x))
        if cut < 2 * width or cut >= len(x):
            return pd.DataFrame(columns=columns)
        mean, sd = x[:cut, 0].mean(), x[:cut, 0].std() or 1.0
        x[:, 0] = (x[:, 0] - mean) / sd
        net = detectors.Gru(x.shape[1], hidden)
        wx, wy = detectors.windows(x[:cut], width, last_inside)
        net.fit(wx, wy, epochs=epochs)
        known = np.abs(wy - net.predict(wx)) * sd
        mu, spread = known.mean(), known.std(ddof=1)
        y = group["diff"].to_numpy(float)
        spans = np.lib.stride_tricks.sliding_window_view(x, width, axis=0).transpose(0, 2, 1)  # a view: it shows values that are replaced
        guesses = net.predict(spans[cut - width : len(x) - width])
        shown, odd = np.empty(len(guesses)), np.zeros(len(guesses), bool)
        stale = -1  # windows up to here hold a replaced value
        for k in range(len(guesses)):
            if k <= stale:
                guesses[k] = net.predict(spans[cut + k - width : cut + k - width + 1])[0]
            shown[k] = max(guesses[k] * sd + mean, 0.0)
            res = abs(y[cut + k] - shown[k])
            odd[k] = threshold is not None and (not np.isfinite(res) or (spread > 0 and abs((res - mu) / spread) > threshold))
            if odd[k]:
                x[cut + k, 0], stale = guesses[k], k + width
        res = np.abs(y[cut:] - shown)
        return pd.DataFrame({"meter_id": group["meter_id"].iloc[cut:], "ts": group["ts"].iloc[cut:], "actual": y[cut:], "predicted": shown, "residual": res, "flagged": odd & np.isfinite(res)})

    return by_meter(recurrent_features(rows), run, "ts timestamp, actual double, predicted double, residual double, flagged boolean")


def reconstruction(rows: DataFrame, *, width: int = 24, share: float = 0.7, hidden: int = 32, epochs: int = 20, around: int = 24, threshold: float = 4.0) -> DataFrame:
    """Each meter's rows as a recurrent network rebuilds them, flagged by the centred score of what it misses.

    The network reads windows of ``width`` rows and gives every value in them back; it is trained on
    the first ``share`` of the rows. A row's rebuilt value is the mean over the windows that hold it.
    """
    names = ["value", "gap", "sin_hour", "cos_hour", "sin_dow", "cos_dow"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts")
        x = group[names].to_numpy(float)
        cut = int(share * len(x))
        if cut < 2 * width:
            return pd.DataFrame(columns=["meter_id", "ts", "actual", "rebuilt", "residual"])
        mean, sd = x[:cut, 0].mean(), x[:cut, 0].std() or 1.0
        x[:, 0] = (x[:, 0] - mean) / sd
        spans = np.lib.stride_tricks.sliding_window_view(x, width, axis=0).transpose(0, 2, 1)
        net = detectors.Gru(x.shape[1], hidden)
        net.fit(spans[: cut - width + 1], spans[: cut - width + 1, :, 0], epochs=epochs)
        total, n = np.zeros(len(x)), np.zeros(len(x))
        for at in range(0, len(spans), 1024):
            found = net.predict_all(spans[at : at + 1024])
            for k in range(width):
                total[at + k : at + k + len(found)] += found[:, k]
                n[at + k : at + k + len(found)] += 1
        rebuilt = total / n * sd + mean
        y = group["diff"].to_numpy(float)
        return pd.DataFrame({"meter_id": group["meter_id"], "ts": group["ts"], "actual": y, "rebuilt": rebuilt, "residual": np.abs(y - rebuilt)})

    from .windows import centered_score

    return centered_score(by_meter(recurrent_features(rows), run, "ts timestamp, actual double, rebuilt double, residual double"), around, threshold=threshold)


def fourier_filter(rows: DataFrame, *, steps: int, q: float = 1e-3, r: float = 1.0, harmonics_: int = 2, lags: list[int] | None = None) -> DataFrame:
    """A filter with a fixed structure for each meter: level and Fourier pairs, or the values at some lags; score is the innovation over its deviation, flagged above 3."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["diff"].notna()].sort_values("ts")
        y = group["diff"].to_numpy(float)
        names = ["meter_id", "ts", "actual", "predicted", "filtered", "innovation", "innovation_var", "score", "flagged"]
        if not len(y):
            return pd.DataFrame(columns=names)
        if lags:
            found = kalman.seasonal_lag_filter(y, lags, q * y.var() + 1e-9, r * y.var() + 1e-9)
        else:
            theta = np.array([r * y.var() + 1e-9, q * y.var() + 1e-9, q * y.var() + 1e-9])
            sys = kalman.system(np.append(theta, theta[-1]), steps, 7 * steps, "fourier", harmonics_)
            found = kalman.run_filter(sys, y, np.concatenate([[y[0]], np.zeros(len(sys.Z) - 1)]), np.eye(len(sys.Z)) * y.var(), lead=True)
        score = np.abs(found.innovation) / np.sqrt(found.variance)
        gain = 1 - (r * y.var() + 1e-9) / found.variance
        return pd.DataFrame({"meter_id": group["meter_id"], "ts": group["ts"], "actual": y, "predicted": found.predicted, "filtered": found.predicted + gain * found.innovation, "innovation": found.innovation, "innovation_var": found.variance, "score": score, "flagged": score > 3})[names]

    return by_meter(rows.select("meter_id", "ts", "diff"), run, "ts timestamp, actual double, predicted double, filtered double, innovation double, innovation_var double, score double, flagged boolean")


def transitions(rows: DataFrame, *, harmonics_: int = 1, forget: float = 0.9999, from_identity: bool = False, stable_rows: int = 24) -> DataFrame:
    """Transition matrix of each meter by recursive least squares over states of value and Fourier pairs, with the covariances of its residuals (``q``), of the estimate (``p``) and of values in stable spells (``r``), and how many of its eigenvalues are unstable."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["diff"].notna()].sort_values("ts")
        t = group["ts"].to_numpy("datetime64[s]").astype(np.int64)
        y = group["diff"].to_numpy(float)
        states = np.column_stack([y] + [f(2 * np.pi * j * t / 86400) for j in range(1, harmonics_ + 1) for f in (np.sin, np.cos)])
        A, Q, P = kalman.recursive_transition(states, forget, np.eye(states.shape[1]) if from_identity else None)
        spread = pd.Series(y).rolling(stable_rows).std()
        calm = y[(spread < spread.quantile(0.25)).to_numpy()]
        return pd.DataFrame([{"meter_id": group["meter_id"].iloc[0], "a": A.ravel(), "q": Q.ravel(), "p": P.ravel(), "r": float(calm.var()) if len(calm) > 1 else float(y.var()), "unstable": kalman.unstable(A)}])

    return by_meter(rows.select("meter_id", "ts", "diff").where(F.col("diff").isNotNull()), run, "a array<double>, q array<double>, p array<double>, r double, unstable int")


def transition_filter(rows: DataFrame, models: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Each meter's rows through a filter with a transition of its own (``a, q, r`` as ``transitions`` gives them).

    The state begins at nothing with the noise for its uncertainty; its first part is what is
    measured, and every value updates it. Score is the innovation over its deviation. Rows without
    a value and meters without a model give none.
    """

    def run(group: pd.DataFrame, own: pd.Series | None) -> pd.DataFrame:
        if own is None:
            return pd.DataFrame(columns=["meter_id"])
        group = group.sort_values("ts", kind="stable")
        y, r = group["diff"].to_numpy(float), float(own["r"])
        A, Q = (np.array(own[c], float) for c in ("a", "q"))
        n = int(round(len(A) ** 0.5))
        sys = kalman.System(A.reshape(n, n), np.eye(n)[0], r, Q.reshape(n, n))
        found = kalman.run_filter(sys, y, np.zeros(n), sys.Q, lead=True)
        score = np.abs(found.innovation) / np.sqrt(found.variance)
        filtered = found.predicted + (found.variance - r) / found.variance * found.innovation
        return pd.DataFrame({"meter_id": group["meter_id"], "ts": group["ts"], "actual": y, "predicted": found.predicted, "filtered": filtered, "innovation": found.innovation, "innovation_var": found.variance, "score": score, "flagged": score > threshold})

    known = rows.where(F.col("diff").isNotNull()).select("meter_id", "ts", "diff")
    return with_models(known, models.where("error IS NULL").select("meter_id", "a", "q", "r"), run, "ts timestamp, actual double, predicted double, filtered double, innovation double, innovation_var double, score double, flagged boolean")


ROLLED = "iteration int, window_start timestamp, train_end timestamp, window_end timestamp, ts timestamp, reading double, status string, flag boolean, diff double, z_current double, pred_current double, pred_next double, lower_band_next double, upper_band_next double, stage string, reasons string, error string"


def rolling_refit(readings: DataFrame, *, train_days: int = 28, predict_days: int = 7, slide_days: int = 7, train: Callable = fit_frame, **options) -> DataFrame:
    """Records of a detector that is fitted anew in every window of a meter and judges the readings after it, all in one grouped job.

    Windows begin at the meter's first midnight and slide until the rows to predict would begin
    after the last one; those with fewer than two rows to fit on or none to judge are passed over.
    A fit starts from the state that the detector had reached after the window before. A meter that
    ``train`` rejects or fails on gives one row that says so (status rejected or failed), and its
    windows end there. ``train`` takes a meter's readings, the signature and state before, and
    ``options``; it returns a row, a model and a state like ``fit_frame``.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["ts"].notna()].sort_values("ts", kind="stable")
        out = []
        if not len(group):
            return pd.DataFrame(out, columns=["meter_id", *_names(ROLLED)])
        day = pd.Timedelta(days=1)
        first, last = group["ts"].iloc[0].floor("D"), group["ts"].iloc[-1]
        before = None
        at = 0
        while (cut := first + at * slide_days * day + train_days * day) < last:
            begin, end = cut - train_days * day, cut + predict_days * day
            window, ahead = group[(group["ts"] >= begin) & (group["ts"] < cut)], group[(group["ts"] >= cut) & (group["ts"] < end)]
            head = {"meter_id": group["meter_id"].iloc[0], "iteration": at, "window_start": begin, "train_end": cut, "window_end": end}
            at += 1
            if len(window) < 2 or not len(ahead):
                continue
            try:
                row, model, state = train(window, before, **options)
            except Exception as problem:  # noqa: BLE001 - what was judged before stays
                out.append(head | {"status": "failed", "error": f"{type(problem).__name__}: {problem}"})
                break
            if model is None:
                out.append(head | {"status": "rejected", "stage": row.get("stage"), "reasons": row.get("reasons")})
                break
            for ts, reading in zip(ahead["ts"], ahead["reading"]):
                state, record = step(model, state, ts.value / 1e9, None if pd.isna(reading) else float(reading))
                out.append(head | {"ts": ts, "reading": reading} | vars(record))
            before = (row["signature"], state)
        return pd.DataFrame(out, columns=["meter_id", *_names(ROLLED)])

    return by_meter(marked(readings), run, ROLLED)


def rolling_summary(records: DataFrame) -> DataFrame:
    """By meter: windows, records and flags, whether and where it was rejected and why, its status, and records by status."""
    from ..streaming.detector import status_counts

    judged = F.col("ts").isNotNull()
    facts = records.groupBy("meter_id").agg(
        F.count_distinct(F.when(judged, F.col("iteration"))).alias("iterations"),
        F.count_if(judged).alias("n_predictions"),
        F.count_if(F.col("flag")).alias("n_flagged"),
        F.max(F.coalesce(F.col("status") == "rejected", F.lit(False))).alias("rejected"),
        F.max(F.when(F.col("status") == "rejected", F.col("iteration"))).alias("rejected_at_iteration"),
        F.max("stage").alias("rejected_stage"),
        F.max("reasons").alias("rejected_reasons"),
        F.max("error").alias("error"),
        F.when(F.max(F.coalesce(F.col("status") == "failed", F.lit(False))), "failed").otherwise("success").alias("status"),
    )
    return facts.join(status_counts(records), "meter_id", "left")


def densities(rows: DataFrame, value: str, low: float, high: float, points: int = 50, clip: float | None = None) -> DataFrame:
    """Kernel density of each meter's values on a common grid; values beyond ``clip`` are left out."""
    kept = rows.where(F.col(value).isNotNull() & (F.abs(value) <= clip if clip is not None else F.lit(True)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = np.linspace(low, high, points)
        return pd.DataFrame({"meter_id": group["meter_id"].iloc[0], "at": at, "density": detectors.density(group[value].to_numpy(float), at)})

    return by_meter(kept.select("meter_id", value), run, "at double, density double")
