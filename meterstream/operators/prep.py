"""Preparation of readings: order, duplicates, increments, and facts about each meter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import seconds
from ..functions.columns import clean_increment
from .joins import shuffled

def by_time():
    """A meter's rows in time."""
    return Window.partitionBy("meter_id").orderBy("ts")



def increments(readings: DataFrame, *, null_as_zero: bool = False) -> DataFrame:
    """Add ``diff``, the cleaned increase since the reading before."""
    return readings.withColumn("diff", clean_increment(F.col("reading") - F.lag("reading").over(by_time()), null_as_zero=null_as_zero))


def intervals(readings: DataFrame) -> DataFrame:
    """Add ``gap_seconds`` since the reading before."""
    return readings.withColumn("gap_seconds", seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(by_time()))


def first_of_duplicates(readings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Of readings of a meter at one time, that which came first; null times go."""
    each = Window.partitionBy("meter_id", "ts").orderBy(ordinal)
    return readings.where(F.col("ts").isNotNull()).withColumn("_n", F.row_number().over(each)).where("_n = 1").drop("_n")


def disorder(readings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Per meter in the order of arrival: rows before the row before them, whether times never fall, and whether readings never do."""
    each = Window.partitionBy("meter_id").orderBy(ordinal)
    step = readings.withColumns({"_t": F.lag("ts").over(each), "_r": F.lag("reading").over(each)})
    return step.groupBy("meter_id").agg(
        F.count_if(F.col("ts") < F.col("_t")).alias("n_back"),
        F.coalesce(F.bool_and(F.col("ts") >= F.col("_t")), F.lit(True)).alias("times_rise"),
        F.coalesce(F.bool_and(F.col("reading") >= F.col("_r")), F.lit(True)).alias("readings_rise"),
    )


def metadata(readings: DataFrame, *, within: float = 300.0, share: float = 0.1) -> DataFrame:
    """One row of facts per meter: counts and nulls, first and last time, range, mean and sample deviation of readings and increments, the most frequent distance (the least of tied ones) with up to ten tied ones, and distances off it.

    Shares of gaps are of all rows, not of distances. A meter with one row has no period and no gaps.
    """
    rows = intervals(readings)
    gaps = rows.where(F.col("gap_seconds").isNotNull()).groupBy("meter_id", "gap_seconds").agg(F.count("*").alias("n"))
    top = gaps.groupBy("meter_id").agg(F.max("n").alias("n"))
    tied = gaps.join(top, ["meter_id", "n"]).groupBy("meter_id").agg(F.array_sort(F.collect_list("gap_seconds")).alias("tied"))
    modes = tied.select("meter_id", F.col("tied")[0].alias("period"), F.slice("tied", 1, 10).alias("periods"))
    off = gaps.join(modes, "meter_id").groupBy("meter_id").agg(
        F.sum(F.when(F.abs(F.col("gap_seconds") - F.col("period")) > within, F.col("n")).otherwise(0)).alias("gaps_fixed"),
        F.sum(F.when((F.col("gap_seconds") < (1 - share) * F.col("period")) | (F.col("gap_seconds") > (1 + share) * F.col("period")), F.col("n")).otherwise(0)).alias("gaps_share"),
    )
    facts = readings.groupBy("meter_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("reading").isNull()).alias("null_readings"),
        F.count_if(F.col("diff").isNull()).alias("null_diffs"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *(f(c).alias(f"{name}_{c}") for c in ("reading", "diff") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))),
    )
    out = facts.join(modes, "meter_id", "left").join(off, "meter_id", "left").fillna(0, ["gaps_fixed", "gaps_share"])
    return out.withColumns({"share_fixed": F.col("gaps_fixed") / F.col("n_rows"), "share_share": F.col("gaps_share") / F.col("n_rows")})


def eligible(facts: DataFrame, *, least_days: int = 365, longest_period: float = 12 * 3600) -> DataFrame:
    """Meters with a long enough span and a short enough period."""
    return facts.where((F.datediff("last_ts", "first_ts") >= least_days) & (F.col("period") <= longest_period))


def repair_order(readings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Mend rows that arrived before their time, meter by meter.

    Places where time falls are found once. At each, if the reading before isn't the larger one,
    the two times change places, else the two rows do. ``failed`` tells meters whose readings fall
    even so. A meter's rows are held in one task.
    """
    schema = readings.select("meter_id", "ts", "reading", ordinal).schema.add("failed", "boolean")

    def mend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ordinal, kind="stable").reset_index(drop=True)
        times, values = rows["ts"].tolist(), rows["reading"].tolist()
        for k in [k for k in range(1, len(times)) if times[k] < times[k - 1]]:
            times[k - 1], times[k] = times[k], times[k - 1]
            if not values[k - 1] <= values[k]:
                values[k - 1], values[k] = values[k], values[k - 1]
        rows["ts"], rows["reading"] = times, values
        rows["failed"] = any(b < a for a, b in zip(values, values[1:]))
        return rows[schema.names]

    return readings.select("meter_id", "ts", "reading", ordinal).groupBy("meter_id").applyInPandas(mend, schema)


def with_facts(rows: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Rows with some of their meter's facts."""
    return shuffled(rows, facts.select("meter_id", *columns), "meter_id")


