"""Hand-checked vectors and properties of the sequential operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterstream.functions import clock, columns
from meterstream.operators import decompose, detectors, grid, joins, kalman, metrics, pipeline, prep, split
from meterstream.streaming import detector
from meterstream.streaming.step import Model, Replay, State, step

DAY = dt.datetime(2024, 1, 1)


def rows(spark, offsets, readings=None, meter=1):
    data = [(meter, DAY + dt.timedelta(seconds=s), float(i if readings is None else readings[i])) for i, s in enumerate(offsets)]
    return spark.createDataFrame(data, "meter_id long, ts timestamp, reading double")


@pytest.mark.parametrize(
    "offsets, want",
    [
        ([0, 3600, 7200, 10800, 14400], [(3600, 0), (7200, 0), (10800, 0), (14400, 0)]),
        ([0, 3600, 7200, 18000, 21600, 25200], [(3600, 0), (7200, 0), (10800, 1), (14400, 1), (18000, 0), (21600, 0), (25200, 0)]),
        ([0, 3600, 7300, 10860, 14460, 18060], [(3600, 0), (7300, 0), (10860, 0), (14460, 0), (18060, 0)]),
        ([0, 3600, 5000, 7200, 10800, 14400], [(3600, 0), (7200, 0), (10800, 0), (14400, 0)]),
        ([0, 3600, 7200, 12600, 16200, 19800], [(3600, 0), (7200, 0), (9900, 1), (12600, 0), (16200, 0), (19800, 0)]),
        ([0, 3600, 7200, 16201, 19801, 23401], [(3600, 0), (7200, 0), (10200, 1), (13200, 1), (16201, 0), (19801, 0), (23401, 0)]),
    ],
)
def test_gap_walk(offsets, want):
    times, at = grid.walk(np.array(offsets, float), 3600.0, 360.0)
    assert [(t, int(k < 0)) for t, k in zip(times, at)] == want


def test_gap_fill_rows(spark):
    found = grid.fill_gaps(rows(spark, [0, 3600, 7200, 18000, 21600, 25200])).orderBy("ts").collect()
    assert [r["synthetic"] for r in found] == [False, False, True, True, False, False, False]
    assert [r["diff"] for r in found] == [None, 1.0, None, None, None, 1.0, 1.0]
    assert len({r["ts"] for r in found}) == len(found)
    assert grid.fill_gaps(rows(spark, [0])).count() == 0


def test_increment_cleaning(spark):
    values = [(0.5,), (-0.001,), (-0.0019,), (-0.002,), (-3.0,), (0.0,), (None,)]
    df = spark.createDataFrame(values, "x double").select(columns.clean_increment(F.col("x")).alias("y"), columns.clean_increment(F.col("x"), null_as_zero=True).alias("z"))
    assert [r["y"] for r in df.collect()] == [0.5, 0.0, 0.0, None, None, 0.0, None]
    assert [r["z"] for r in df.collect()][-1] == 0.0


def test_local_time(spark):
    def utc(times):
        data = [(1, dt.datetime.fromisoformat(t), i) for i, t in enumerate(times)]
        df = clock.local_to_utc(spark.createDataFrame(data, "meter_id long, ts_local timestamp, ordinal long"))
        return [r["ts_utc"] and r["ts_utc"].strftime("%H:%M") for r in df.orderBy("ordinal").collect()]

    def half_hours(day, *spans):
        return [f"{day} {h:02d}:{m:02d}" for a, b in spans for h in range(a, b) for m in (0, 30)]

    autumn = half_hours("2024-10-27", (0, 3), (2, 4))
    assert utc(autumn) == ["22:00", "22:30", "23:00", "23:30", "00:00", "00:30", "01:00", "01:30", "02:00", "02:30"]
    assert utc(["2024-03-31 01:15", "2024-03-31 02:15", "2024-03-31 03:15"]) == ["00:15", None, "01:15"]
    assert utc(half_hours("2024-10-27", (1, 4))) == ["23:00", "23:30", None, None, "02:00", "02:30"]
    assert utc(["2024-10-27 02:15"]) == [None]


def test_order_repair(spark):
    data = [(1, DAY + dt.timedelta(hours=h), v, i) for i, (h, v) in enumerate([(0, 1.0), (2, 2.0), (1, 3.0), (3, 4.0)])]
    found = prep.repair_order(spark.createDataFrame(data, "meter_id long, ts timestamp, reading double, ordinal long")).orderBy("ordinal").collect()
    assert [(r["ts"].hour, r["reading"]) for r in found] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)] and not found[0]["failed"]


def test_interval_sums(spark):
    actual = spark.createDataFrame([(1, DAY + dt.timedelta(minutes=m), d) for m, d in ((0, 0.1), (90, 0.2), (240, 0.0), (250, 0.3))], "meter_id long, ts timestamp, diff double")
    guess = spark.createDataFrame([(1, DAY + dt.timedelta(minutes=m), 1.0) for m in range(0, 241, 30)], "meter_id long, ts timestamp, predicted double")
    assert [(r["actual"], r["predicted"]) for r in joins.interval_sums(actual, guess).orderBy("ts").collect()] == [(0.2, 3.0), (0.0, 5.0)]


def test_quantile_bins_share_edges(spark):
    df = metrics.quantile_bins(spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3, 4, 5, 6)], "v double"), "v", 4)
    assert sorted(r["count"] for r in df.groupBy("bin").count().collect()) == [2, 2, 4]


def test_filter_likelihood_and_fit():
    rng = np.random.default_rng(1)
    t = np.arange(24 * 21)
    y = 5 + 2 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.3, len(t))
    theta, llf, _ = kalman.fit(y, 24, 168, most=80)
    worse = kalman.run_filter(kalman.system(theta * 10, 24, 168), y).llf
    assert llf > worse
    run = kalman.run_filter(kalman.system(theta, 24, 168), y)
    assert np.abs(y[100:] - run.predicted[100:]).mean() < 0.45
    y[200] = np.nan
    assert np.isnan(kalman.run_filter(kalman.system(theta, 24, 168), y).innovation[200])
    for variant in kalman.VARIANTS:
        sys = kalman.system(np.ones(kalman.n_theta(variant)), 24, 168, variant)
        assert sys.T.shape == sys.Q.shape == (len(sys.Z),) * 2
    assert kalman.unstable(kalman.system(theta, 24, 168).T) == 0


def test_decomposition_finds_the_season():
    t = np.arange(24 * 14)
    rng = np.random.default_rng(2)
    assert decompose.diagnostics(3 + np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.1, len(t)), 24, 168)["f_s_daily"] > 0.9
    assert np.isnan(decompose.diagnostics(np.ones(10), 24, 168)["f_s_daily"])


def test_other_detectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[7] = 12
    assert detectors.isolation_scores(x).argmax() == 7
    X = np.column_stack([np.ones(500), rng.normal(size=500)])
    y = rng.poisson(np.exp(0.5 + 0.7 * X[:, 1])).astype(float)
    beta, _, _ = detectors.negative_binomial(X, y, 0.1)
    assert np.allclose(beta, [0.5, 0.7], atol=0.15)
    assert abs(detectors.negative_binomial_pmf(np.arange(400.0), np.full(400, 3.0), 0.5).sum() - 1) < 1e-6
    wave = np.sin(np.arange(200) / 4)[:, None]
    wx, wy = detectors.windows(wave, 12)
    assert np.allclose(wy[0], wave[12, 0])
    net = detectors.Gru(1, 8)
    losses = net.fit(wx, wy, epochs=15, rate=1e-2)
    assert losses[-1] < losses[0] / 3
    values = rng.normal(size=300)
    grid_ = np.linspace(-6, 6, 400)
    assert abs(np.trapezoid(detectors.density(values, grid_), grid_) - 1) < 1e-2


def test_network_gradient():
    net = detectors.Gru(2, 3, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(4, 5, 2)), rng.normal(size=4)
    before = {k: v.copy() for k, v in net.p.items()}
    loss = lambda: float(((net.predict(x) - y) ** 2).mean())
    eps, want = 1e-6, {}
    for k in ("W", "U", "c"):
        flat = net.p[k].ravel()
        flat[0] += eps
        up = loss()
        flat[0] -= 2 * eps
        down = loss()
        flat[0] += eps
        want[k] = (up - down) / (2 * eps)
    net.step(x, y, rate=1e-3, clip=1e9)  # Adam's first step goes against the gradient's sign
    for k, g in want.items():
        assert np.sign(before[k].ravel()[0] - net.p[k].ravel()[0]) == np.sign(g)


def model(**more):
    sys = kalman.system(np.array([0.1, 0.01, 1e-4, 1e-4]), 24, 168)
    return Model(sys.T, sys.Z, sys.H, sys.Q, np.eye(9), 3600.0, 24, 168, np.full(24, 0.1), np.full(24, 0.1), 0.1, 0.1, **more)


@pytest.mark.parametrize(
    "delta, change, status",
    [(3600, None, "invalid"), (0, 1, "skipped_duplicate"), (-5, 1, "skipped_duplicate"), (3239, 0, "skipped_early"), (5400, 0, "post_gap_skipped"), (9000, 0, "post_gap_skipped"), (12600, 0, "post_gap_skipped"), (3600, -0.002, "reset"), (169 * 3600, 0, "post_gap_skipped"), (170 * 3600, 0, "outage")],
)
def test_step_statuses(delta, change, status):
    state = State(np.zeros(9), np.eye(9), 1_704_067_200.0, 0.0)
    after, record = step(model(), state, state.time + delta, None if change is None else float(change))
    assert record.status == status
    assert (after is state) == (status in ("invalid", "skipped_duplicate", "skipped_early"))


def test_step_judges():
    state = State(np.zeros(9), np.eye(9), 1_704_067_200.0, 100.0)
    assert step(model(), state, state.time + 3240, 100.1)[1].status == "ok"
    found = step(model(), state, state.time + 3600, 100.0 - 0.001)[1]
    assert found.status in ("ok", "anomaly") and found.diff == 0
    far, record = step(model(), state, state.time + 3600, 150.0)
    assert record.status == "anomaly" and record.flag and np.allclose(far.x, model().T @ state.x)


def readings(spark, days=16):
    rng = np.random.default_rng(5)
    t = np.arange(24 * days)
    data = []
    for meter in (1, 2):
        total = 100 + np.cumsum(np.maximum(1 + meter * (1 + np.sin(2 * np.pi * t / 24)) + rng.normal(0, 0.05, len(t)), 0))
        data += [(meter, DAY + dt.timedelta(hours=int(h)), float(v)) for h, v in zip(t, total) if not (meter == 2 and 300 < h < 304)]
    return spark.createDataFrame(data, "meter_id long, ts timestamp, reading double")


def test_fit_replay_and_stream_agree(spark, tmp_path):
    every = readings(spark)
    cut = F.lit(DAY + dt.timedelta(days=12))
    models = pipeline.fit_meters(every.where(F.col("ts") < cut), most=25, checked=False)
    models = spark.createDataFrame(models.toPandas(), models.schema).cache()
    assert {r["status"] for r in models.select("status").collect()} == {"success"}
    later = every.where(F.col("ts") >= cut)
    replayed = detector.replay(later, models)
    counts = {r["status"]: r["count"] for r in replayed.groupBy("status").count().collect()}
    assert sum(counts.values()) == later.count() and counts["ok"] > 150 and counts["post_gap_skipped"] == 1
    own, state = detector.load_model(models.where("meter_id = 1").first()["model"])
    memory = Replay(own, state)
    for r in later.where("meter_id = 1").orderBy("ts").collect():
        memory.feed(pd.Timestamp(r["ts"]).value / 1e9, r["reading"])
    assert memory.counts == {r["status"]: r["count"] for r in replayed.where("meter_id = 1").groupBy("status").count().collect()}
    later.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(later.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = detector.detect_stream(stream, models).writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = spark.table("records")
    key = ["meter_id", "ts", "status"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, replayed.select(key).collect()))


def test_gate_and_failures_are_rows(spark):
    noise = np.random.default_rng(1).uniform(0, 1, 24 * 14).cumsum()
    got = pipeline.fit_meters(rows(spark, [3600 * k for k in range(len(noise))], noise), most=10).first()
    assert got["status"] == "rejected" and "seasonality" in got["reasons"]
    slow = pipeline.fit_meters(rows(spark, [86400 * k for k in range(40)]), most=5).first()
    assert slow["status"] == "failed" and "fewer than two steps" in slow["error"]


def test_spikes_and_starts_repeat(spark):
    df = readings(spark).withColumn("diff", F.lit(1.0) + F.hour("ts") / 10)
    a, b = (split.inject_spikes(df).where("is_anomaly != 0").orderBy("meter_id", "ts").collect() for _ in range(2))
    assert a == b and 2 <= len(a) <= 20
    assert all(abs(r["diff"] - r["diff_original"] - r["is_anomaly"]) < 1e-9 for r in a)
    facts = df.groupBy("meter_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    starts = split.random_starts(facts, days=7).collect()
    assert len(starts) == 2 and all(r["start"].hour == 0 for r in starts)
    assert split.random_starts(facts, days=60).count() == 0
    parts = split.split_meters(spark.range(10).withColumnRenamed("id", "meter_id"))
    assert parts.where("part = 'train'").count() == 8


def test_predicates_reject_unknown(spark):
    with pytest.raises(ValueError):
        split.candidates(spark.range(1), [{"name": "x", "value": 1, "comparator": "=="}])
    with pytest.raises(ValueError):
        split.candidates(spark.range(1), [{"name": "id", "value": 1, "comparator": "~"}])


def test_imputation():
    from meterstream.operators import impute

    t = np.arange(120.0)
    y = np.sin(t / 9)
    gap = y.copy()
    gap[60:63] = np.nan
    assert np.abs(impute.forecast_gaps(gap) - y).max() < 0.05
    assert np.abs(impute.cubic(np.where(np.isfinite(gap), gap + 2, np.nan)) - y - 2).max() < 0.01
    assert np.isnan(impute.forecast_gaps(np.array([np.nan, 1.0]))[0]) and impute.forecast_gaps(np.array([1.0, np.nan]))[1] == 1.0


def test_seeds(spark):
    import zlib

    got = spark.range(5).select(split.seed_of(F.col("id"), 12345).alias("s")).collect()
    assert [r["s"] for r in got] == [(12345 * 1000003 + zlib.crc32(str(k).encode())) % (1 << 63) for k in range(5)]
