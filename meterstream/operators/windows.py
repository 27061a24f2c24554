"""Windows over a meter's rows in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import seconds
from .joins import shuffled

def by_time():
    """A meter's rows in time."""
    return Window.partitionBy("meter_id").orderBy("ts")



def lags(rows: DataFrame, n: int, value: str = "diff") -> DataFrame:
    return rows.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(by_time()) for k in range(1, n + 1)})


def trailing_mean(rows: DataFrame, n: int = 3, value: str = "diff") -> DataFrame:
    """Mean of the last ``n`` rows that there are."""
    return rows.withColumn(f"{value}_mean_{n}", F.avg(value).over(by_time().rowsBetween(1 - n, 0)))


def centered_score(rows: DataFrame, n: int = 24, value: str = "residual", threshold: float = 4.0) -> DataFrame:
    """Score against mean and deviation of the ``n`` rows around, for an even ``n`` one more before than after; only full windows count."""
    around = by_time().rowsBetween(-(n // 2), n - n // 2 - 1)
    full = F.count(value).over(around) == n
    score = F.when(full, (F.col(value) - F.avg(value).over(around)) / (F.stddev_samp(value).over(around) + 1e-6))
    return rows.withColumn("rolling_z", score).withColumn("rolling_flag", F.coalesce(F.abs("rolling_z") > threshold, F.lit(False)).cast("int"))


def stable(rows: DataFrame, n: int = 24, value: str = "diff", quantile: float = 0.25) -> DataFrame:
    """Add ``is_stable``: the deviation of the last ``n`` rows is below its own quantile for the meter."""
    trailing = by_time().rowsBetween(1 - n, 0)
    out = rows.withColumn("_std", F.when(F.count(value).over(trailing) == n, F.stddev_samp(value).over(trailing)))
    cut = out.groupBy("meter_id").agg(F.expr(f"percentile(_std, {quantile})").alias("_cut"))
    return shuffled(out, cut, "meter_id").withColumn("is_stable", F.coalesce(F.col("_std") < F.col("_cut"), F.lit(False))).drop("_std", "_cut")


def filled(rows: DataFrame, value: str = "reading") -> DataFrame:
    """Missing values from the row before (0 where there is none, which ``_any`` tells), from the row after, and between both by row and by time (ends are carried on)."""
    # the row after is the last one seen from the end: a frame that only grows, where one that shrinks would be gone through anew for each row
    back = by_time().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("meter_id").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), seconds(F.col("ts")).alias("t"), F.col("_n").alias("n")))
    out = rows.withColumn("_n", F.row_number().over(by_time())).withColumns({"_a": F.last(known, ignorenulls=True).over(back), "_b": F.last(known, ignorenulls=True).over(ahead)})

    def between(at, field: str):
        share = F.try_divide(at - F.col(f"_a.{field}"), F.col(f"_b.{field}") - F.col(f"_a.{field}"))
        inner = F.col("_a.v") + F.coalesce(share, F.lit(0.0)) * (F.col("_b.v") - F.col("_a.v"))
        return F.coalesce(inner, F.col("_a.v"), F.col("_b.v"))

    return out.withColumns({f"{value}_any": F.col("_a").isNotNull(), f"{value}_ffill": F.coalesce(F.col("_a.v"), F.lit(0.0)), f"{value}_bfill": F.col("_b.v"), f"{value}_linear": between(F.col("_n"), "n"), f"{value}_time": between(seconds(F.col("ts")), "t")}).drop("_n", "_a", "_b")


def cumulative(rows: DataFrame, value: str = "diff") -> DataFrame:
    return rows.withColumn(f"{value}_total", F.sum(value).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def valid_pairs(rows: DataFrame, period: float, tolerance: float = 0.1) -> DataFrame:
    """Share of successive rows whose distance is within ``tolerance`` of the period, by meter, and whether it is too low."""
    gap = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(by_time())
    out = rows.withColumn("_ok", (F.abs(gap - period) <= tolerance * period).cast("double")).groupBy("meter_id").agg((100 * F.avg("_ok")).alias("valid_pct"))
    return out.withColumn("warned", F.coalesce(F.col("valid_pct") < 80, F.lit(True)))


def state_vectors(rows: DataFrame, size: int, period: float, *, tolerance: float = 0.1, value: str = "diff") -> DataFrame:
    """The ``size`` values up to each row, in order, and the value after it, where the distances of all these rows from those before them are within ``tolerance`` of the period; rows without a value don't count."""
    known = rows.where(F.col(value).isNotNull()).withColumn("_gap", seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(by_time()))
    odd = F.max((~F.coalesce(F.abs(F.col("_gap") - period) <= tolerance * period, F.lit(False))).cast("int")).over(by_time().rowsBetween(1 - size, 1))
    own = by_time().rowsBetween(1 - size, 0)
    held = known.withColumns({"state": F.collect_list(value).over(own), "next": F.lead(value).over(by_time()), "_odd": odd, "_n": F.count("*").over(own)})
    return held.where((F.col("_n") == size) & F.col("next").isNotNull() & (F.col("_odd") == 0)).select("meter_id", "ts", "state", "next")


def warmed_up(rows: DataFrame, n: int = 480) -> DataFrame:
    """Rows of a meter after its first ``n``."""
    return rows.withColumn("_n", F.row_number().over(by_time())).where(F.col("_n") > n).drop("_n")


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each meter."""
    latest = Window.partitionBy("meter_id").orderBy(F.desc("ts"))
    return rows.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")


def first_and_last(rows: DataFrame, value: str = "reading") -> DataFrame:
    """First and last known value of each meter."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy("meter_id").agg(F.min_by(value, "ts").alias(f"first_{value}"), F.max_by(value, "ts").alias(f"last_{value}"))
