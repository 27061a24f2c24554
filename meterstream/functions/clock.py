"""Time arithmetic: periods, positions in a cycle, local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86400


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, with the fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def effective_period(mode: Column) -> Column:
    """The grid period for a most frequent distance: null below 180 s, and short ones multiplied, each rule on what the one before left."""
    five = F.when(mode < 300, mode * 5).otherwise(mode)
    three = F.when(five < 420, five * 3).otherwise(five)
    two = F.when(three < 600, three * 2).otherwise(three)
    return F.when(mode >= 180, two)


def steps_per_day(period: Column) -> Column:
    """Steps in a day, rounded half to even."""
    return F.bround(DAY / period).cast("int")


def steps_per_cycle(period: Column, cycle: str | float = "daily") -> Column:
    """Steps in a day, a week or a number of seconds; an unknown name means a day."""
    if cycle == "weekly":
        return 7 * steps_per_day(period)
    if isinstance(cycle, (int, float)):
        return F.bround(F.lit(float(cycle)) / period).cast("int")
    return steps_per_day(period)


def position(ts: Column, period: Column, steps: Column) -> Column:
    """Place in the daily cycle: second of the UTC day over the period, half to even, modulo the steps."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.pmod(F.bround(second / period).cast("int"), steps)


def neighbourhood(steps: Column, hours: float = 2.0, least: int = 2) -> Column:
    """Positions on either side that are pooled; no fewer than ``least``, so that coarse meters pool enough."""
    return F.greatest(F.lit(least), F.bround(hours * steps / 24).cast("int"))


def parsed_local(text: Column) -> Column:
    """Local time from ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def local_to_utc(rows: DataFrame, zone: str = "Europe/Prague", *, key: str = "meter_id", local: str = "ts_local", order: str = "ordinal") -> DataFrame:
    """Add ``ts_utc`` to rows with wall-clock times, in the order in which they came.

    Times that a clock change skipped become null. Times that occur twice are told apart by their
    order: in a run of them exactly one step back (or standstill) must mark the change. If any run
    of a meter lacks it or has more than one, all repeated times of that meter become null.
    The session's time zone must be UTC.
    """
    early = F.to_utc_timestamp(F.col(local), zone)  # of two candidates Spark takes the summer one
    missing = F.from_utc_timestamp(early, zone) != F.col(local)
    twice = F.from_utc_timestamp(early + F.expr("INTERVAL 1 HOUR"), zone) == F.col(local)
    each = Window.partitionBy(key).orderBy(order)
    out = rows.withColumns({"_early": early, "_missing": missing, "_twice": F.coalesce(twice, F.lit(False))})
    out = out.withColumn("_starts", (F.col("_twice") & ~F.coalesce(F.lag("_twice").over(each), F.lit(False))).cast("int"))
    out = out.withColumn("_run", F.sum("_starts").over(each))
    back = F.col("_twice") & F.coalesce(F.lag("_twice").over(each), F.lit(False)) & (F.col(local) <= F.lag(local).over(each))
    out = out.withColumn("_back", F.coalesce(back, F.lit(False)).cast("int"))
    run = Window.partitionBy(key, "_run", "_twice")
    out = out.withColumns({"_steps": F.sum("_back").over(run), "_passed": F.sum("_back").over(run.orderBy(order))})
    out = out.withColumn("_failed", F.max((F.col("_twice") & (F.col("_steps") != 1)).cast("int")).over(Window.partitionBy(key)))
    late = F.col("_early") + F.expr("INTERVAL 1 HOUR")
    utc = F.when(F.col("_missing"), F.lit(None)).when(F.col("_twice") & (F.col("_failed") == 1), F.lit(None)).when(F.col("_twice") & (F.col("_passed") > 0), late).otherwise(F.col("_early"))
    return out.withColumn("ts_utc", utc).drop("_early", "_missing", "_twice", "_starts", "_run", "_back", "_steps", "_passed", "_failed")
