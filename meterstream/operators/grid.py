"""Regular grids: adaptive gap filling, resampling, calendars."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import effective_period, seconds
from ..functions.columns import NOISE, clean_increment
from .joins import nearest, shuffled

GRID = "meter_id {key}, ts timestamp, reading double, is_anomaly double, diff double, period double, synthetic boolean"


def period_of(stamps: np.ndarray) -> float | None:
    """The effective period of sorted times in seconds; None without a usable one."""
    gaps = np.diff(stamps)
    if not len(gaps):
        return None
    values, counts = np.unique(gaps, return_counts=True)
    mode = float(values[counts.argmax()])  # the least of tied ones
    if mode < 180:
        return None
    for limit, times in ((300, 5), (420, 3), (600, 2)):
        mode = mode * times if mode < limit else mode
    return mode


def walk(stamps: np.ndarray, period: float, tolerance: float) -> tuple[list[float], list[int]]:
    """Grid times and, for each, the row that stands there (-1 for a made-up one).

    From each grid time the next is sought one period on: the nearest row within ``tolerance``
    (the earlier of equally near ones), else the first row at least half a period away, with made-up
    times spread over the whole periods before it, each rounded to a second. Rows come sorted and
    are passed by once, so the walk is linear. The first row is where it starts and isn't emitted.
    """
    times, rows = [], []
    stamps = np.asarray(stamps).tolist()
    n = len(stamps)
    if n < 2:
        return times, rows
    now, last, k = stamps[0], stamps[-1], 0  # k: the last row that is used up
    while now + period <= last:
        target = now + period
        j = k + 1
        while j < n and stamps[j] < target - tolerance:
            j += 1
        best = -1
        while j < n and stamps[j] <= target + tolerance:
            if best < 0 or abs(stamps[j] - target) < abs(stamps[best] - target):
                best = j
            j += 1
        if best < 0:
            j = k + 1
            while j < n and (stamps[j] <= now or stamps[j] - now < 0.5 * period):
                j += 1
            if j >= n:
                break
            best = j
            steps = round((stamps[best] - now) / period)
            at = now
            for _ in range(steps - 1):
                at = float(round(at + (stamps[best] - now) / steps))
                times.append(at)
                rows.append(-1)
        times.append(float(stamps[best]))
        rows.append(best)
        now, k = stamps[best], best
    return times, rows


def marked(readings: DataFrame) -> DataFrame:
    """``meter_id, ts, reading, is_anomaly``, the last 0 where readings have no such column."""
    return readings.select("meter_id", "ts", F.col("reading").cast("double").alias("reading"), (F.col("is_anomaly").cast("double") if "is_anomaly" in readings.columns else F.lit(0.0)).alias("is_anomaly"))


def _filled(stamps: np.ndarray, value: np.ndarray, mark: np.ndarray, tolerance_pct: float) -> dict[str, np.ndarray]:
    """The grid of one meter's rows: ``ts`` in microseconds, ``reading, is_anomaly, diff, period, synthetic``, missing numbers as NaN; ``stamps`` are seconds, sorted and different."""
    period = period_of(stamps)
    times, at = walk(stamps, period, tolerance_pct / 100 * period) if period else ([], [])
    at = np.array(at, dtype=int)
    reading = np.where(at >= 0, value[at], np.nan) if len(at) else np.array([])
    diff = np.diff(reading, prepend=np.nan)
    return {
        "ts": np.round(np.array(times) * 1e6).astype("int64"),
        "reading": reading,
        "is_anomaly": np.where(at >= 0, mark[at], 0.0) if len(at) else reading,
        "diff": np.where(diff <= -NOISE, np.nan, np.where(diff < 0, 0.0, diff)),
        "period": np.full(len(at), period if period else np.nan),
        "synthetic": at < 0,
    }


def filled_frame(group: pd.DataFrame, tolerance_pct: float = 10.0) -> pd.DataFrame:
    """The grid of one meter's rows: ``meter_id, ts, reading, is_anomaly, diff, period, synthetic``, missing numbers as NaN."""
    group = group[group["ts"].notna()].sort_values("ts", kind="stable").drop_duplicates("ts", keep="first")
    stamps = group["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6
    found = _filled(stamps, group["reading"].to_numpy(float), group["is_anomaly"].to_numpy(float), tolerance_pct)
    return pd.DataFrame({"meter_id": group["meter_id"].iloc[0] if len(group) else None, **found, "ts": pd.to_datetime(found["ts"], unit="us")})


def fill_gaps(readings: DataFrame, *, tolerance_pct: float = 10.0) -> DataFrame:
    """Put each meter's readings on a grid that follows them; made-up rows have no reading.

    Increments are taken anew on the grid, so that a made-up row and the row after it have none.
    Meters without a usable period, or with one row, give no rows. One meter is held at a time, as
    columns: a frame for each meter would cost several times its walk.
    """
    key = readings.schema["meter_id"].dataType.simpleString()

    def fill(group: pa.Table) -> pa.Table:
        ids = group.column("meter_id").slice(0, 1).combine_chunks()
        known = group.filter(pc.is_valid(group.column("ts")))
        micros = known.column("ts").cast(pa.int64()).to_numpy()
        order = np.argsort(micros, kind="stable")
        order = order[np.diff(micros[order], prepend=-1 << 63) != 0] if len(order) else order
        value, mark = (known.column(c).to_numpy()[order] for c in ("reading", "is_anomaly"))
        found = _filled(micros[order] / 1e6, value, mark, tolerance_pct)
        columns = {c: pa.array(v, from_pandas=True) for c, v in found.items()} | {"ts": pa.array(found["ts"]).cast(pa.timestamp("us", "UTC"))}
        return pa.table({"meter_id": ids.take(pa.array(np.zeros(len(found["ts"]), dtype=np.int64))), **columns})

    rows = marked(readings).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("meter_id").applyInArrow(fill, GRID.format(key=key))


def unmatched(readings: DataFrame, grid: DataFrame) -> DataFrame:
    """Readings that the grid left out, with the readings before and after them and the nearest grid time (the earlier of equally near ones) and how far it is."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    around = readings.withColumns({"before_ts": F.lag("ts").over(each), "after_ts": F.lead("ts").over(each)})
    lost = shuffled(around, grid.where(~F.col("synthetic")).select("meter_id", "ts"), ["meter_id", "ts"], "left_anti")
    slots = grid.select("meter_id", F.col("ts").cast("timestamp").alias("ts"), F.col("synthetic").alias("slot"))
    out = nearest(lost.withColumn("ts", F.col("ts").cast("timestamp")), slots, tolerance=float("inf"), value="slot")
    return out.withColumn("slot_distance", seconds(F.col("nearest_ts")) - seconds(F.col("ts"))).withColumnsRenamed({"nearest_ts": "slot_ts", "nearest_slot": "slot_synthetic"})


def odd_spacing(grid: DataFrame) -> DataFrame:
    """Grid rows that are less than half or more than one and a half periods after the row before."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    gap = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(each)
    return grid.withColumn("gap_seconds", gap).where((F.col("gap_seconds") < 0.5 * F.col("period")) | (F.col("gap_seconds") > 1.5 * F.col("period")))


def periods(readings: DataFrame) -> DataFrame:
    """Most frequent distance (the least of tied ones) and grid period of each meter."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    gaps = readings.withColumn("gap_seconds", seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(each))
    return gaps.groupBy("meter_id").agg(F.mode("gap_seconds", True).alias("mode_seconds")).withColumn("period", effective_period(F.col("mode_seconds")))


def hourly(readings: DataFrame, how: str = "mean", fill: str | None = None) -> DataFrame:
    """One row for each hour from a meter's first to its last: mean, first or last reading in it (nearest to the hour: the first), how many there were, whether there was none, and the seconds from the last reading before it to its first one.

    ``fill`` says what stands in hours without a reading: null, the value before (``ffill``), the
    value after (``bfill``) or one between both by time (``time``).
    """
    pick = {"mean": F.avg("reading"), "first": F.min_by("reading", "ts"), "last": F.max_by("reading", "ts"), "nearest": F.min_by("reading", "ts")}[how]
    each = Window.partitionBy("meter_id").orderBy("ts")
    hours = readings.groupBy("meter_id", F.date_trunc("hour", "ts").alias("_hour")).agg(pick.alias("reading"), F.count("reading").alias("readings_count"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    hours = hours.withColumnRenamed("_hour", "ts").withColumn("time_gap", seconds(F.col("_first")) - seconds(F.lag("_last").over(each))).drop("_first", "_last")
    out = shuffled(_calendar(hours, "1 HOUR"), hours, ["meter_id", "ts"], "left").withColumn("interpolated", F.col("readings_count").isNull()).fillna(0, ["readings_count"])
    if fill is None:
        return out
    from .windows import filled

    kept = [c for c in out.columns if c != "reading"]
    return filled(out).select(*kept, F.when(F.col("reading").isNotNull(), F.col("reading")).otherwise({"ffill": F.when(F.col("reading_any"), F.col("reading_ffill")), "bfill": F.col("reading_bfill"), "time": F.col("reading_time")}[fill]).alias("reading"))


def _calendar(rows: DataFrame, step: str) -> DataFrame:
    return rows.groupBy("meter_id").agg(F.explode(F.sequence(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"), F.expr(f"INTERVAL {step}"))).alias("ts"))


def at_frequency(readings: DataFrame, step: str = "30 MINUTES") -> DataFrame:
    """Readings at exact steps from the first; null where there is none."""
    rows = readings.select("meter_id", F.col("ts").cast("timestamp").alias("ts"), "reading")
    return shuffled(_calendar(rows, step), rows, ["meter_id", "ts"], "left")


def gap_rows(readings: DataFrame, period: float) -> DataFrame:
    """Rows to add in gaps longer than a period: as many whole periods as lie between two readings, less one."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    gaps = readings.withColumn("_next", F.lead("ts").over(each)).withColumn("_n", F.floor((seconds(F.col("_next")) - seconds(F.col("ts"))) / period) - 1)
    steps = F.sequence(F.lit(1), F.col("_n").cast("int"))
    return gaps.where("_n >= 1").select("meter_id", F.col("ts").alias("_t"), F.explode(steps).alias("_k")).select("meter_id", F.timestamp_micros(F.unix_micros(F.col("_t").cast("timestamp")) + (F.col("_k") * period * 1e6).cast("long")).alias("ts"))


def gap_filled(readings: DataFrame, period: float) -> DataFrame:
    """Readings with rows added in gaps longer than a period, whose readings lie between those around them by time; ``synthetic`` tells them."""
    from .windows import filled

    rows = readings.select("meter_id", F.col("ts").cast("timestamp").alias("ts"), "reading", F.lit(False).alias("synthetic"))
    added = gap_rows(readings, period).select("meter_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("reading"), F.lit(True).alias("synthetic"))
    return filled(rows.unionByName(added)).select("meter_id", "ts", F.coalesce("reading", F.when(F.col("synthetic"), F.col("reading_time"))).alias("reading"), "synthetic")


def off_period(readings: DataFrame, slack: float = 300.0) -> DataFrame:
    """By meter: the most frequent distance, how many distances are longer than it by more than ``slack`` seconds, the longest of all, and whether there is none such."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    gaps = shuffled(readings.withColumn("_gap", seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(each)), periods(readings).select("meter_id", "mode_seconds"), "meter_id")
    late = F.count_if(F.col("_gap") > F.col("mode_seconds") + slack)
    return gaps.groupBy("meter_id", "mode_seconds").agg(late.alias("n_late"), F.max("_gap").alias("longest_gap")).withColumn("periodic", F.col("n_late") == 0)


def fill_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after, share of rows without a reading, share of readings kept, share of the time covered, and made-up rows and their share, by meter."""
    a = before.groupBy("meter_id").agg(F.count("*").alias("n_before"), (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("_span"))
    b = after.groupBy("meter_id").agg(
        F.count("*").alias("n_after"), (100 * F.avg(F.col("reading").isNull().cast("int"))).alias("fill_pct"), F.count("reading").alias("_kept"), F.count_if("synthetic").alias("n_made_up"), (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("_covered")
    )
    out = shuffled(a, b, "meter_id", "left").fillna(0, ["n_after", "n_made_up"])
    return out.withColumns({"reduction": 1 - F.col("n_after") / F.col("n_before"), "preserved": F.col("_kept") / F.col("n_before"), "coverage": F.try_divide("_covered", "_span"), "made_up_rate": F.try_divide("n_made_up", "n_after")}).drop("_kept", "_span", "_covered")


def recleaned(grid: DataFrame) -> DataFrame:
    """Increments of a grid taken anew; cleaning clean increments changes nothing."""
    each = Window.partitionBy("meter_id").orderBy("ts")
    return grid.withColumn("diff", clean_increment(F.col("reading") - F.lag("reading").over(each)))
