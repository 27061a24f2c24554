"""Segments, seeded windows, samples, injected anomalies, and set operations on meters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .joins import clustered, shuffled

_COMPARE = {"==": lambda c, v: c.eqNullSafe(v), "!=": lambda c, v: ~c.eqNullSafe(v), "<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v}


def candidates(rows: DataFrame, predicates: list[dict]) -> DataFrame:
    """Rows that meet all of ``{name, value, comparator}``; null differs from every value. Unknown columns or comparators raise."""

    def one(p: dict) -> Column:
        if p["name"] not in rows.columns:
            raise ValueError(f"no column {p['name']}; there are {rows.columns}")
        if p["comparator"] not in _COMPARE:
            raise ValueError(f"no comparator {p['comparator']}")
        return F.coalesce(_COMPARE[p["comparator"]](F.col(p["name"]), F.lit(p["value"])), F.lit(False))

    return rows.where(reduce(lambda a, b: a & b, map(one, predicates), F.lit(True)))


def between(rows: DataFrame, start: Column, end: Column, closed: bool = False) -> DataFrame:
    """Rows from ``start`` up to ``end``, which belongs to it only if ``closed``."""
    return rows.where((F.col("ts") >= start) & ((F.col("ts") <= end) if closed else (F.col("ts") < end)))


def good_meters(rows: DataFrame) -> DataFrame:
    """Add each criterion of a well-behaved meter and all of them together; a missing value doesn't meet it."""
    checks = {"good_strength": F.col("f_s_daily") >= 0.5, "good_mase": F.col("mase_seasonal") < 0.95, "good_fill": F.col("filled_pct_second") <= 10}
    out = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    return out.withColumn("good", reduce(lambda a, b: a & b, (F.col(k) for k in checks)))


def segments(rows: DataFrame, starts: DataFrame, *, train_days: int | Column, second_days: int, predict_days: int) -> DataFrame:
    """Rows in a meter's segments that follow each other from its ``start``: train, second, predict. Each is closed before and open after.

    ``train_days`` may be a column, such as seven times ``weeks_to_train`` of the meter's period.
    """
    day = F.datediff(F.col("ts"), F.col("start"))
    train = train_days if isinstance(train_days, Column) else F.lit(train_days)
    name = F.when(day < train, "train").when(day < train + second_days, "second").when(day < train + second_days + predict_days, "predict")
    return shuffled(rows, starts, "meter_id").where(F.col("ts") >= F.col("start")).withColumn("segment", name).where(F.col("segment").isNotNull())


def window_rows(rows: DataFrame, starts: DataFrame, *, weeks: int, train_weeks: int | None = None) -> DataFrame:
    """Rows of each meter's window of ``weeks`` from its ``start``; with ``train_weeks``, ``segment`` tells the first ones (train) from the rest (stream)."""
    out = shuffled(rows, starts, "meter_id").where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + F.make_interval(weeks=F.lit(weeks))))
    return out if train_weeks is None else out.withColumn("segment", F.when(F.col("ts") < F.col("start") + F.make_interval(weeks=F.lit(train_weeks)), "train").otherwise("stream"))


def month_segments(rows: DataFrame, months: int = 3) -> DataFrame:
    """The last ``months`` calendar months of a meter: all but the last for training, that for prediction."""
    last = rows.groupBy("meter_id").agg(F.date_trunc("month", F.max("ts")).alias("_last"))
    out = shuffled(rows, last, "meter_id").where(F.col("ts") >= F.add_months("_last", -(months - 1)).cast("timestamp"))
    return out.withColumn("segment", F.when(F.col("ts") < F.col("_last"), "train").otherwise("predict")).drop("_last")


def rolling_windows(rows: DataFrame, *, train_days: int = 28, predict_days: int = 7, slide_days: int = 7) -> DataFrame:
    """Counts of rows in each refit window of each meter; windows without two training rows or one to predict are left out, and none starts predicting after the data end."""
    bounds = rows.groupBy("meter_id").agg(F.date_trunc("day", F.min("ts")).alias("first"), F.max("ts").alias("last"))
    n = F.floor((F.datediff("last", "first") - train_days) / slide_days)
    starts = bounds.where(n >= 0).select("meter_id", "last", F.explode(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: F.date_add(F.col("first").cast("date"), k * slide_days))).alias("start"))
    # each row belongs to a bounded number of windows, so days are joined rather than ranges
    days = starts.select("meter_id", "start", "last", F.explode(F.sequence(F.lit(0), F.lit(train_days + predict_days - 1))).alias("d")).select("meter_id", "start", "last", F.date_add("start", F.col("d")).alias("day"), (F.col("d") < train_days).alias("training"))
    counts = rows.groupBy("meter_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = days.join(counts, ["meter_id", "day"]).groupBy("meter_id", "start", "last").agg(F.sum(F.when(F.col("training"), F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(F.col("training"), 0).otherwise(F.col("n"))).alias("n_predict"))
    return out.where((F.col("n_train") >= 2) & (F.col("n_predict") >= 1) & (F.date_add("start", train_days).cast("timestamp") < F.col("last"))).drop("last")


def seed_of(name: Column, seed: int) -> Column:
    """A seed for each meter from one for all: ``(seed * 1000003 + crc32(name)) mod 2^63``."""
    return ((F.lit(seed).cast("decimal(38,0)") * 1000003 + F.crc32(name.cast("string").cast("binary"))) % F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("long")


def recent(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the year before ``now`` (the current time where it isn't given)."""
    now = F.current_timestamp() if now is None else now
    return rows.where(F.col("ts") > now - F.expr("INTERVAL 1 YEAR"))


def active(facts: DataFrame, since: Column) -> DataFrame:
    """Meters whose last reading isn't before ``since``."""
    return facts.where(F.col("last_ts") >= since)


def sampled(rows: DataFrame, key: str, n: int = 1, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key: the same whatever their order or partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def first_meters(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` meters by id."""
    return rows.join(rows.select("meter_id").distinct().orderBy("meter_id").limit(n), "meter_id", "left_semi")


def weeks_to_train(period: Column, long: int = 4, short: int = 2) -> Column:
    """Weeks of training: fewer where a meter reads more often than every 20 minutes."""
    return F.when(period < 20 * 60, short).otherwise(long)


def random_starts(facts: DataFrame, *, days: int, tries: int = 30, seed: int | None = None, covered: DataFrame | None = None) -> DataFrame:
    """A midnight at which a window of ``days`` begins, drawn for each meter.

    A draw is a uniform time up to the last at which a window fits, taken back to midnight; it
    counts if the window ends within the data and, with ``covered`` (rows with ``ts``), each of its
    days has one. The seed is the meter's id if that is a number, else its checksum; with ``seed``
    it is that of ``seed_of``. Meters whose data are too short, or whose draws all fail, have none.
    """
    key = facts.schema["meter_id"].dataType.simpleString()
    number = F.col("meter_id").cast("string").try_cast("long")
    own = F.coalesce(number, F.crc32(F.col("meter_id").cast("string").cast("binary"))) if seed is None else seed_of(F.col("meter_id"), seed)
    rows = facts.where(F.col("meter_id").isNotNull()).select("meter_id", "first_ts", "last_ts", F.abs(own).alias("seed"))
    if covered is not None:
        held = covered.groupBy("meter_id").agg(F.collect_set(F.unix_date(F.to_date("ts"))).alias("held"))  # a number for each day of a meter
        rows = rows.join(held, "meter_id", "left")

    def draw(frames):
        for pdf in frames:
            out = []
            for meter, first, last, number, *held in pdf.itertuples(index=False):
                if pd.isna(first) or pd.isna(last):
                    continue
                rng = np.random.default_rng(int(number))
                span = last - first - pd.Timedelta(days=days)
                own = set() if not held or held[0] is None else set(held[0])
                for _ in range(tries if span >= pd.Timedelta(0) else 0):
                    start = (first + span * rng.random()).floor("D")
                    day = (start - pd.Timestamp(0)).days
                    if start + pd.Timedelta(days=days) <= last and (not held or all(day + k in own for k in range(days))):
                        out.append((meter, start))
                        break
            yield pd.DataFrame(out, columns=["meter_id", "start"])

    return rows.mapInPandas(draw, f"meter_id {key}, start timestamp")


def split_meters(meters: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``part``: train for that share of the different meters, rounded down, in the order of a seeded hash; test for the others.

    A null id is a meter too. The hash of the last meter to train on is found by its rank, so that
    no list of meters is made; meters with that very hash (of 52 bits) go together.
    """
    place = F.pmod(F.xxhash64("meter_id", F.lit(seed)), F.lit(1 << 52))
    ids = meters.select("meter_id").distinct().select(place.alias("place"))
    n = ids.count()
    k = int(share * n)
    last = metrics.at_ranks(ids, "place", [k - 1], n)[k - 1] if k else -1.0
    return meters.withColumn("part", F.when(place <= last, "train").otherwise("test"))


def inject_spikes(rows: DataFrame, *, least: int = 1, most: int = 10, low: float = 3.0, high: float = 10.0, seed: int = 42) -> DataFrame:
    """Add spikes to some increments of each meter: from three times as many places as spikes, those with a value get between ``low`` and ``high`` deviations more.

    ``is_anomaly`` holds what was added, ``diff_original`` what there was. The seed is the same for every meter.
    """
    out = rows.select("meter_id", "ts", "diff")
    schema = f"meter_id {out.schema['meter_id'].dataType.simpleString()}, ts timestamp, diff double, diff_original double, is_anomaly double"

    def spikes(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(seed)
        x = group["diff"].to_numpy(float)
        added = np.zeros(len(x))
        sigma = np.nanstd(x, ddof=1) if np.isfinite(x).sum() > 1 else np.nan
        if not sigma > 0:
            positive = x[x > 0]
            sigma = float(np.median(positive)) if len(positive) else 0.001
        n = int(rng.integers(least, most + 1))
        places = rng.choice(len(x), size=min(len(x), 3 * n), replace=False)
        done = 0
        for k in places:
            factor = rng.uniform(low, high)
            if done < n and np.isfinite(x[k]):
                added[k] = factor * sigma
                done += 1
        return pd.DataFrame({"meter_id": group["meter_id"], "ts": group["ts"], "diff": x + added, "diff_original": x, "is_anomaly": added})

    return out.groupBy("meter_id").applyInPandas(spikes, schema)


def membership(flags: DataFrame, *names: str) -> DataFrame:
    """How many meters each combination of flags has."""
    return flags.groupBy(*names).agg(F.count("*").alias("n"))


def shards(readings: DataFrame, path: str, *, rows_a_file: int = 500_000) -> int:
    """Write readings by meter and year of each row: a folder for each year, files of whole meters in it; the rows read back are counted and must be as many."""
    n = readings.count()
    clustered(readings.withColumn("year", F.year("ts")), "year", tasks=max(-(-n // rows_a_file), 1)).write.partitionBy("year").parquet(path)
    found = readings.sparkSession.read.parquet(path).count()
    if found != n:
        raise RuntimeError(f"{n} rows were written and {found} read back")
    return n
