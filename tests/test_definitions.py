"""Definitions by hand-worked vectors, and what must hold at any size."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterstream.operators import decompose, detectors, grid, impute, joins, kalman, metrics, pipeline, split, windows
from meterstream.sources import shared, tables
from meterstream.streaming import detector

DAY = dt.datetime(2024, 1, 1)
NAN = float("nan")


def at(k):
    return DAY + dt.timedelta(hours=k)


def test_regression_by_hand(spark):
    data = [(1, at(0), 0.0, 1.0, 5.0), (1, at(1), 0.0, 1.0, 1.0), (1, at(2), None, 3.0, 2.0), (1, at(3), 2.0, NAN, 1.0), (1, at(4), 2.0, 1.0, None), (1, at(5), 4.0, 2.0, 3.0), (1, at(6), 4.0, 2.0, 3.0), (2, at(0), None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "meter_id long, ts timestamp, actual double, predicted double, residual double")
    got = {r["meter_id"]: r for r in metrics.regression(df, "meter_id").collect()}
    one = got[1]
    assert (one["metric_total_count"], one["metric_valid_count"], one["metric_nan_count"], one["metric_non_zero_count"], one["metric_zero_count"]) == (7, 4, 3, 2, 2)
    assert one["metric_valid_percentage"] == pytest.approx(400 / 7) and one["metric_non_zero_percentage"] == 50
    assert (one["metric_mean_residual"], one["metric_max_residual"], one["metric_min_residual"]) == (3.0, 5.0, 1.0)  # of the column, not of the distance
    assert one["metric_std_residual"] == pytest.approx(np.std([5, 1, 3, 3]))
    assert one["metric_median_ape"] == pytest.approx(np.median([1e8, 1e8, 2 / (4 + 1e-8), 2 / (4 + 1e-8)]), rel=1e-9)
    assert one["metric_mpe"] == pytest.approx(np.mean([-1e8, -1e8, 2 / (4 + 1e-8), 2 / (4 + 1e-8)]), rel=1e-9)
    assert one["metric_mape"] == pytest.approx(np.mean([1 / 2.220446049250313e-16] * 2 + [0.5, 0.5]), rel=1e-9)
    assert one["metric_direction_accuracy"] == 1.0  # flat and flat agree, 0 to 4 and 1 to 2 both rise, flat and flat
    assert got[2]["metric_total_count"] == 1 and got[2]["metric_valid_count"] == 0 and got[2]["metric_rmse"] is None
    assert metrics.regression(df, "meter_id", nonzero=True).count() == 0  # no more than two rows
    flat = spark.createDataFrame([(1, at(k), 2.0, p) for k, p in enumerate((1.0, 0.5, 3.0))], "meter_id long, ts timestamp, actual double, predicted double")
    assert metrics.regression(flat, "meter_id").first()["metric_direction_accuracy"] == 0.5  # flat against a fall agrees, against a rise it doesn't
    assert metrics.regression(flat, "meter_id").first()["metric_r2"] == 0.0
    assert metrics.regression(flat.withColumn("predicted", F.lit(2.0)), "meter_id").first()["metric_r2"] == 1.0


def test_intermittency_by_hand(spark):
    data = [(1, x) for x in (0.0, 2.0, None, 0.0, 4.0, -3.0)] + [(2, 0.0), (2, None)] + [(3, None)] + [(4, 5.0), (4, 0.0)]
    got = {r["meter_id"]: r for r in metrics.intermittency(spark.createDataFrame(data, "meter_id long, diff double")).collect()}
    assert (got[1]["adi"], got[1]["n_periods"], got[1]["n_nonzero"], got[1]["nonzero_fraction"]) == (2.5, 5, 2, 0.4)
    assert got[1]["cv2"] == pytest.approx((math.sqrt(2) / 3) ** 2)
    assert got[2]["adi"] == math.inf and got[2]["cv2"] is None and got[2]["nonzero_fraction"] == 0
    assert got[3]["adi"] is None and got[3]["n_periods"] == 0
    assert got[4]["cv2"] == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 5, 500)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(7)
    shares = [0, 0.013, 0.25, 0.5, 0.731, 0.99, 1]
    for bucket in (1_000_000, 40):
        assert np.allclose(metrics.quantiles(df, "v", shares, rows_a_bucket=bucket), np.quantile(values, shares), atol=1e-12)
    assert metrics.quantiles(df.limit(0), "v", shares) == [] and metrics.quantile_bins(df.limit(0), "v").count() == 0
    assert metrics.quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.0, 0.5, 1.0]) == [3.0] * 3


def test_autocorrelation_facts(spark):
    wave = [(1, at(k), math.sin(2 * math.pi * k / 24)) for k in range(24 * 15)] + [(2, at(k), 1.0) for k in range(400)] + [(3, at(k), float(k % 2)) for k in range(10)]
    df = spark.createDataFrame(wave, "meter_id long, ts timestamp, diff double")
    got = {r["meter_id"]: r for r in metrics.autocorrelation_facts(df, grid.periods(df)).collect()}
    x = np.array([v for m, _, v in wave if m == 1])
    x = x - x.mean()
    want = [(x[k:] * x[:-k]).sum() / (x * x).sum() for k in range(1, 169)]
    assert got[1]["max_autocorr_lag"] == int(np.argmax(np.abs(want))) + 1 and got[1]["max_autocorr"] == pytest.approx(max(want, key=abs))
    assert got[1]["autocorr_mean"] == pytest.approx(np.mean(want)) and got[1]["autocorr_std"] == pytest.approx(np.std(want))
    assert got[2]["max_autocorr"] is None and got[3]["max_autocorr_lag"] is None


def test_normality_statistic(spark):
    """Against the published formulas, step by step, on a skewed sample."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=60), rng.exponential(size=25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    facts = df.agg(F.count("v").alias("n"), F.skewness("v").alias("s"), F.kurtosis("v").alias("k"))
    got = metrics.with_normality(facts, "p", "n", "s", "k").first()["p"]
    assert metrics.with_normality(facts.withColumn("n", F.lit(7)), "p", "n", "s", "k").first()["p"] is None
    n, d = len(x), x - x.mean()
    m2, skew, kurt = (d**2).mean(), (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    u = (kurt - e) / math.sqrt(v)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    z2 = ((1 - 2 / (9 * a)) - np.cbrt((1 - 2 / a) / (1 + u * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / (9 * a))
    assert m2 > 0 and got == pytest.approx(math.exp(-(z1**2 + z2**2) / 2), rel=1e-9)


def test_seasons_are_taken_out_together():
    rng = np.random.default_rng(3)
    t = np.arange(24 * 7 * 6)
    y = 6 + np.sin(2 * np.pi * t / 24) + 1.5 * (t % 168 < 48) + rng.normal(0, 0.2, len(t))
    found = decompose.diagnostics(y, 24, 168)
    seasons, rest = decompose.several(y, [24, 168])
    assert found["f_s_daily"] == decompose.strength(seasons[24], rest) and found["f_s_daily"] > 0.85 and found["f_s_weekly"] > 0.85
    _, alone, left = decompose.stl(y, 24)
    assert decompose.strength(alone, left) < found["f_s_daily"]  # the week in the remainder hides the day
    assert found["residual_cv2"] == pytest.approx((rest.std(ddof=1) / y.mean()) ** 2)
    gaps = y.copy()
    gaps[100:140] = np.nan
    gaps[5] = -2.0
    again = decompose.diagnostics(gaps, 24, 168)
    good = np.isfinite(gaps)
    _, rest = decompose.several(np.interp(t, t[good], gaps[good]), [24, 168])
    assert again["residual_cv2"] == pytest.approx((rest[good].std(ddof=1) / gaps[good & (gaps > 0)].mean()) ** 2)  # observed rows, over positive ones
    assert again["residual_cv2_robust"] == pytest.approx((1.4826 * np.median(np.abs(rest[good] - np.median(rest[good]))) / np.median(gaps[good & (gaps > 0)])) ** 2)
    assert math.isnan(decompose.diagnostics(y, 24, 168, longest=100)["f_s_weekly"]) and decompose.diagnostics(np.zeros(100), 24, 168)["f_s_daily"] == 0
    assert math.isnan(decompose.diagnostics(np.full(30, np.nan), 24, 168)["f_s_daily"])


def test_places_of_a_cycle_are_smoothed_one_by_one(monkeypatch):
    rng = np.random.default_rng(12)
    for n, period in ((240, 24), (247, 24), (50, 7), (41, 2)):
        y = rng.normal(size=n)
        want = decompose.stl(y, period)
        monkeypatch.setattr(decompose, "_cycle_smoother", lambda rows, width: np.column_stack([decompose.loess(e, width, np.arange(-1, rows + 1, dtype=float)) for e in np.eye(rows)]))
        assert all(np.allclose(a, b) for a, b in zip(want, decompose.stl(y, period)))
        monkeypatch.undo()
        trend, season, rest = want
        assert np.allclose(trend + season + rest, y)
        cycle = np.zeros(n + 2 * period)
        for k in range(period):
            part = y[k::period]
            cycle[k::period][: len(part) + 2] = decompose.loess(part, 7, np.arange(-1, len(part) + 1, dtype=float))
        passed = decompose.loess(decompose._mean(decompose._mean(decompose._mean(cycle, period), period), 3), period + 1 + period % 2)
        assert np.allclose(decompose.stl(y, period, rounds=1)[1], cycle[period : period + n] - passed[:n])


def test_smoother_repeats_lines_and_reaches_the_ends():
    y = 3 + 0.5 * np.arange(50.0)
    assert np.allclose(decompose.loess(y, 7), y) and np.allclose(decompose.loess(y, 7, np.array([-1.0, 50.0])), [2.5, 28.0]) and np.allclose(decompose.loess(y[:5], 11), y[:5])


def test_likelihoods_are_those_of_the_filter():
    rng = np.random.default_rng(7)
    y = rng.normal(size=200)
    y[20:30] = np.nan
    for variant in kalman.VARIANTS:
        thetas = np.exp(rng.normal(-2, 1, (3, kalman.n_theta(variant))))
        n = len(kalman.system(thetas[0], 12, 84, variant).Z)
        for x, P in ((None, None), (rng.normal(size=n), np.eye(n) * 0.3)):
            want = [kalman.run_filter(kalman.system(t, 12, 84, variant), y, x, P).llf for t in thetas]
            assert np.allclose(kalman.likelihoods(thetas, y, 12, 84, variant, x, P), want, atol=1e-4)


def test_a_known_state_is_expected_at_the_first_value():
    sys = kalman.system(np.array([0.1, 0.01, 1e-3, 1e-3]), 24, 168)
    x = np.arange(9.0)
    assert kalman.run_filter(sys, np.ones(3), x, np.eye(9)).predicted[0] == sys.Z @ x
    assert kalman.run_filter(sys, np.ones(3), x, np.eye(9), lead=True).predicted[0] == pytest.approx(sys.Z @ sys.T @ x)


def test_search_settles_at_a_summit():
    rng = np.random.default_rng(8)
    t = np.arange(24 * 21)
    y = 5 + 2 * np.sin(2 * np.pi * t / 24) + np.cumsum(rng.normal(0, 0.05, len(t))) + rng.normal(0, 0.3, len(t))
    theta, llf, settled = kalman.fit(y, 24, 168)
    assert settled
    for k in range(4):
        for factor in (0.7, 1.4):
            other = theta.copy()
            other[k] *= factor
            assert kalman.likelihoods(other[None], y, 24, 168)[0] <= llf + 5e-3
    assert not kalman.fit(y, 24, 168, most=1)[2]


def readings(spark, days=21, meters=(1, 2), key="long"):
    rng = np.random.default_rng(5)
    t = np.arange(24 * days)
    data = []
    for meter in meters:
        total = 100 + np.cumsum(np.maximum(2 + 1 + np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.05, len(t)), 0))
        data += [(str(meter) if key == "string" else meter, at(int(h)), float(v)) for h, v in zip(t, total)]
    return spark.createDataFrame(data, f"meter_id {key}, ts timestamp, reading double")


def test_warm_start_is_from_the_kept_state(spark):
    every = readings(spark)
    cut = F.lit(at(24 * 14))
    first = pipeline.fit_meters(every.where(F.col("ts") < cut), checked=False)
    first = spark.createDataFrame(first.toPandas(), first.schema)
    again = {r["meter_id"]: r for r in pipeline.fit_meters(every, previous=first, checked=False).collect()}
    frame = every.where("meter_id = 1").toPandas()
    _, state = detector.load_model(first.where("meter_id = 1").first()["model"])
    grid_ = grid.filled_frame(frame.assign(is_anomaly=0.0))
    theta, llf, _ = kalman.fit(grid_["diff"].to_numpy(float), 24, 168, x=state.x, P=state.P)
    assert again[1]["warm_started"] and again[1]["llf"] == pytest.approx(llf) and np.allclose(again[1]["theta"], theta)
    other = first.withColumn("signature", F.lit("another"))
    assert not any(r["warm_started"] for r in pipeline.fit_meters(every, previous=other, checked=False).collect())
    # a refit is judged by the refits' gate: a share filled of 12 % passes it alone
    holes = every.where("hour(ts) != 3 AND hour(ts) != 10 AND hour(ts) != 17")
    got = pipeline.fit_meters(holes, previous=first).collect()
    assert {r["stage"] for r in got} <= {None, "post_train"} and all(r["fill_pct"] > 10 for r in got)
    assert {(r["status"], r["stage"], r["reasons"]) for r in pipeline.fit_meters(holes).collect()} == {("rejected", "pre_train", "fill")}


def test_holdout_and_scaled_errors(spark):
    got = pipeline.fit_meters(readings(spark), holdout_days=7, scaled_by="mase", checked=False).collect()
    assert {(r["status"], r["n_fit"], r["n_reference"]) for r in got} == {("success", 24 * 14 - 1 - 1, 24 * 7 + 1)}
    assert pipeline.scaled_error(np.array([1.0, 3.0, np.nan]), np.array([2.0, 2.0, 2.0]), np.array([0.0, 2.0, np.nan, 4.0, 8.0]), 1) == pytest.approx(1 / 3)
    assert math.isnan(pipeline.scaled_error(np.ones(3), np.ones(3), np.ones(3), 1)) and math.isnan(pipeline.scaled_error(np.ones(3), np.ones(3), np.ones(3), 9))


def test_rolling_refits_carry_the_state_on(spark):
    every = readings(spark, days=30)
    got = pipeline.rolling_refit(every, train_days=14, predict_days=7, slide_days=7, checked=False)
    got = spark.createDataFrame(got.toPandas(), got.schema)
    per = {(r["meter_id"], r["iteration"]): r["count"] for r in got.groupBy("meter_id", "iteration").count().collect()}
    assert per == {(m, k): n for m in (1, 2) for k, n in ((0, 168), (1, 168), (2, 48))}
    frame = every.where("meter_id = 1").toPandas().assign(is_anomaly=0.0)
    before = None
    for k in range(3):
        begin = pd.Timestamp(DAY) + pd.Timedelta(days=7 * k)
        cut, end = begin + pd.Timedelta(days=14), begin + pd.Timedelta(days=21)
        row, model, state = pipeline.fit_frame(frame[(frame["ts"] >= begin) & (frame["ts"] < cut)], before, checked=False)
        assert row["warm_started"] == (k > 0)
        part = frame[(frame["ts"] >= cut) & (frame["ts"] < end)]
        want = []
        for ts, reading in zip(part["ts"], part["reading"]):
            state, record = pipeline.step(model, state, ts.value / 1e9, reading)
            want.append((ts, record.status, record.flag))
        before = (row["signature"], state)
        mine = got.where((F.col("meter_id") == 1) & (F.col("iteration") == k)).orderBy("ts").collect()
        assert [(pd.Timestamp(r["ts"]), r["status"], r["flag"]) for r in mine] == want
    summary = {r["meter_id"]: r for r in pipeline.rolling_summary(got).collect()}
    assert summary[1]["iterations"] == 3 and summary[1]["n_predictions"] == 384 and summary[1]["status"] == "success" and not summary[1]["rejected"]
    noise = np.random.default_rng(1).uniform(0, 1, 24 * 30).cumsum()
    odd = spark.createDataFrame([(7, at(k), float(v)) for k, v in enumerate(noise)], "meter_id long, ts timestamp, reading double")
    turned = pipeline.rolling_refit(odd, train_days=14, predict_days=7, slide_days=7).collect()
    assert [(r["status"], r["iteration"], r["stage"]) for r in turned] == [("rejected", 0, "pre_train")]

    def broken(window, before, **options):
        raise ValueError("no")

    assert [(r["status"], r["error"]) for r in pipeline.rolling_refit(odd, train=broken).collect()] == [("failed", "ValueError: no")]


def test_one_bad_meter_ends_no_job(spark):
    rows = readings(spark, days=8, key="string").withColumn("diff", F.lit(1.0) + F.hour("ts") / 10)
    bad = spark.createDataFrame([("bad", at(k), 1.0, v) for k, v in enumerate([math.inf, -math.inf] * 60)], "meter_id string, ts timestamp, reading double, diff double")
    both = rows.unionByName(bad)
    jobs = [pipeline.seasonal_strength(both, 24, 168), pipeline.isolation(both), pipeline.count_models(both), pipeline.recurrent(both, epochs=1), pipeline.fourier_filter(both, steps=24), pipeline.transitions(both), pipeline.local_level(both, q=1.0, r=1.0, p0=1.0), impute.imputed(both.select("meter_id", "ts", "diff")), pipeline.densities(both, "diff", 0.0, 5.0), pipeline.rolling_refit(both, train_days=5, predict_days=2, slide_days=2, checked=False)]
    for job in jobs:
        found = job.collect()
        assert {"1", "2"} <= {r["meter_id"] for r in found if r["error"] is None}, job.columns
    assert pipeline.transitions(both).where("error IS NOT NULL").select("meter_id").distinct().collect() == [("bad",)]


def test_count_thresholds_are_stored_and_used(spark):
    rng = np.random.default_rng(9)
    data = [(1, at(k), float(v)) for k, v in enumerate(rng.poisson(6, 600))] + [(1, at(600), 90.0)] + [(2, at(k), 1.0) for k in range(20)]
    df = spark.createDataFrame(data, "meter_id long, ts timestamp, diff double")
    models = pipeline.count_models(df.where(F.col("ts") < at(500)))
    got = {r["meter_id"]: r for r in models.collect()}
    assert got[2]["status"] == "too_short" and got[1]["status"] == "success"
    scored = pipeline.count_scores(df.where(F.col("ts") >= at(490)), models).collect()
    assert {r["meter_id"] for r in scored} == {1} and all(r["flagged"] == (r["score"] > got[1]["threshold"]) for r in scored) and next(r for r in scored if r["diff"] == 90)["flagged"]


def test_network_rebuilds_windows(spark):
    wave = np.sin(np.arange(120) / 4)[:, None]
    spans = np.lib.stride_tricks.sliding_window_view(wave, 8, axis=0).transpose(0, 2, 1)
    net = detectors.Gru(1, 6, seed=2)
    losses = net.fit(spans, spans[:, :, 0], epochs=20, rate=1e-2)
    assert losses[-1] < losses[0] / 4 and net.predict_all(spans).shape == (113, 8) and np.allclose(net.predict_all(spans)[:, -1], net.predict(spans))
    x, y = np.random.default_rng(0).normal(size=(3, 5, 1)), np.random.default_rng(1).normal(size=(3, 5))
    before, want = {k: v.copy() for k, v in net.p.items()}, {}
    for k in ("W", "U", "c", "V"):
        flat = net.p[k].ravel()
        loss = []
        for eps in (1e-6, -2e-6):
            flat[0] += eps
            loss.append(((net.predict_all(x) - y) ** 2).mean())
        flat[0] += 1e-6
        want[k] = loss[0] - loss[1]
    net.m, net.t = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}, 0
    net.step(x, y, rate=1e-3, clip=1e9)
    for k, g in want.items():
        assert np.sign(before[k].ravel()[0] - net.p[k].ravel()[0]) == np.sign(g)


def test_rolled_network_equals_one_window_at_a_time(spark):
    rng = np.random.default_rng(10)
    y = 5 + np.sin(np.arange(200) / 4) + rng.normal(0, 0.1, 200)
    y[170] = 40.0
    data = [(1, at(k), None if k == 180 else float(v)) for k, v in enumerate(y)]
    df = spark.createDataFrame(data, "meter_id long, ts timestamp, diff double")
    got = pipeline.recurrent(df, epochs=2).orderBy("ts").collect()
    frame = pipeline.recurrent_features(df).toPandas().sort_values("ts")
    x = frame[["value", "gap", "sin_hour", "cos_hour", "sin_dow", "cos_dow"]].to_numpy(float)
    mean, sd = x[:140, 0].mean(), x[:140, 0].std()
    x[:, 0] = (x[:, 0] - mean) / sd
    net = detectors.Gru(6, 32)
    wx, wy = detectors.windows(x[:140].copy(), 24)
    net.fit(wx, wy, epochs=2)
    known = np.abs(wy - net.predict(wx)) * sd
    for k, r in zip(range(140, 200), got):
        guess = float(net.predict(x[None, k - 24 : k])[0])
        res = abs((r["actual"] if r["actual"] is not None else np.nan) - max(guess * sd + mean, 0))
        odd = not np.isfinite(res) or abs((res - known.mean()) / known.std(ddof=1)) > 3.5
        x[k, 0] = guess if odd else x[k, 0]
        assert r["predicted"] == pytest.approx(max(guess * sd + mean, 0), abs=1e-9) and r["flagged"] == (odd and np.isfinite(res))
    assert any(r["flagged"] for r in got)


def test_transition_filter_steps(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(1, at(k), None if k == 5 else float(v)) for k, v in enumerate(rng.normal(4, 1, 60))] + [(2, at(0), 1.0)], "meter_id long, ts timestamp, diff double")
    A, Q, r = np.array([[0.9, 0.1], [-0.1, 0.8]]), np.array([[0.3, 0.05], [0.05, 0.2]]), 0.7
    models = spark.createDataFrame([(1, A.ravel().tolist(), Q.ravel().tolist(), r, None)], "meter_id long, a array<double>, q array<double>, r double, error string")
    got = pipeline.transition_filter(df, models).orderBy("ts").collect()
    x, P = np.zeros(2), Q.copy()
    values = [row["diff"] for row in df.where("meter_id = 1 AND diff IS NOT NULL").orderBy("ts").collect()]
    assert len(got) == 59
    for row, y in zip(got, values):
        x, P = A @ x, A @ P @ A.T + Q
        S = P[0, 0] + r
        assert row["predicted"] == pytest.approx(x[0]) and row["innovation_var"] == pytest.approx(S) and row["flagged"] == (abs(y - x[0]) / S**0.5 > 3)
        K = P[:, 0] / S
        x, P = x + K * (y - x[0]), P - np.outer(K, P[0])
        assert row["filtered"] == pytest.approx(x[0])


def test_splines_repeat_cubics():
    t = np.arange(40.0)
    y = 500 + 0.01 * (t - 20) ** 3 + 0.2 * t
    gap = y.copy()
    gap[[1, 2, 7, 8, 9, 20, 30, 31, 38]] = np.nan
    assert np.allclose(impute.cubic(gap), y)  # a spline without knots at the ends is the cubic itself
    three = np.array([1.0, np.nan, 4.0, np.nan, 3.0])
    assert np.allclose(impute.cubic(three), np.polyval(np.polyfit([0, 2, 4], [1, 4, 3], 2), np.arange(5)))
    assert impute.cubic(np.array([np.nan, 2.0, np.nan, 4.0])).tolist() == [2, 2, 3, 4] and np.isnan(impute.cubic(np.full(3, np.nan))).all()


def test_starts_need_covered_days_and_any_id(spark):
    rows = readings(spark, days=30, key="string").unionByName(readings(spark, days=30, key="string").withColumn("meter_id", F.concat(F.lit("m"), "meter_id")))
    facts = rows.groupBy("meter_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    facts = facts.unionByName(spark.createDataFrame([(None, DAY, DAY), ("none", None, None)], facts.schema))
    got = {r["meter_id"]: r["start"] for r in split.random_starts(facts, days=7).collect()}
    assert set(got) == {"1", "2", "m1", "m2"}
    rng = np.random.default_rng(1)
    span = pd.Timedelta(hours=24 * 30 - 1) - pd.Timedelta(days=7)
    assert pd.Timestamp(got["1"]) == (pd.Timestamp(DAY) + span * rng.random()).floor("D")
    holes = rows.where("dayofmonth(ts) NOT IN (8, 16, 24)")
    assert split.random_starts(facts, days=8, covered=holes).count() == 0
    for r in split.random_starts(facts, days=6, covered=holes, seed=3).collect():
        days = {r["start"].day + k for k in range(6)}
        assert not days & {8, 16, 24}


def test_split_counts_different_meters(spark):
    df = spark.createDataFrame([(k // 5,) for k in range(50)] + [(None,)], "meter_id long")
    parts = split.split_meters(df)
    by = {}
    for r in parts.collect():
        by.setdefault(r["meter_id"], set()).add(r["part"])
    assert len(by) == 11 and all(len(x) == 1 for x in by.values()) and sum(x == {"train"} for x in by.values()) == 8 and parts.count() == 51


def test_upsert_keeps_meters_of_either_side(spark):
    facts = spark.createDataFrame([(1, 5.0, None), (2, 6.0, "a"), (None, 1.0, "n")], "meter_id long, x double, note string")
    more = spark.createDataFrame([(7, 1, "b"), (8, 9, None), (9, None, "m")], "extra int, meter_id long, note string")
    got = {(r["meter_id"], r["x"], r["note"], r["extra"]) for r in tables.augmented(facts, more).collect()}
    assert got == {(1, 5.0, "b", 7), (2, 6.0, "a", None), (9, None, None, 8), (None, 1.0, "m", 9)}


def test_shared_folder_must_be_named_on_a_cluster(spark):
    assert shared.shared_path(spark, "x").startswith("file:")

    class Conf:
        def get(self, name):
            return None if name == "spark.checkpoint.dir" else "file:/w"

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": lambda self: Conf(), "getCheckpointDir": lambda self: None, "master": "local"})()

    assert shared.shared_path(Session(), "x").startswith("file:/w-work/x-")
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared.shared_path(Session(), "x")
    assert shared.kept(spark.range(3), "kept").count() == 3


@pytest.mark.parametrize("name", ["nearest", "interval_sums", "filled", "local_level"])
def test_cost_is_linear_in_a_meter(spark, name):
    """Four times the rows of one meter may cost a few times as much, not sixteen times."""

    def rows(n):
        return spark.range(n).select(F.lit(1).alias("meter_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("reading"), (F.col("id") % 7).cast("double").alias("diff"), F.lit(1.0).alias("predicted"))

    def run(n):
        a = rows(n)
        b = a.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
        job = {"nearest": lambda: joins.nearest(a, b), "interval_sums": lambda: joins.interval_sums(a.where("diff = 0"), b), "filled": lambda: windows.filled(a), "local_level": lambda: pipeline.local_level(a, q=1.0, r=2.0, p0=1.0)}[name]()
        began = time.perf_counter()
        job.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run(2_000)
    small, large = run(40_000), run(160_000)
    assert large < 8 * small + 1.5
