"""Joins in time that stay linear: coverage, nearest neighbours, sums between readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clock import seconds


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides by their keys.

    Spark guesses the size of exploded rows and of Python's output from that of what they are made
    of, and would send millions of such rows through the driver to broadcast them.
    """
    return left.join(right.hint("merge"), on, how)


def clustered(rows: DataFrame, *more: str, tasks: int | None = None) -> DataFrame:
    """Rows as a sink writes them: a meter's rows lie together in one file of many meters, which the file's statistics tell.

    Folders of one meter each would be as many as the meters, and their writing, commit and listing cost more than their rows.
    """
    dealt = rows.repartition("meter_id") if tasks is None else rows.repartition(tasks, "meter_id")
    return dealt.sortWithinPartitions(*more, "meter_id", "ts")


def day_coverage(readings: DataFrame) -> DataFrame:
    """Readings of each meter on every day from its first to its last, 0 on days without."""
    counts = readings.groupBy("meter_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = readings.groupBy("meter_id").agg(F.explode(F.sequence(F.to_date(F.min("ts")), F.to_date(F.max("ts")), F.expr("INTERVAL 1 DAY"))).alias("day"))
    return shuffled(days, counts, ["meter_id", "day"], "left").fillna(0, ["n"])


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose meter and time aren't in the other table, or have no reading there."""
    other = after.select("meter_id", "ts", F.col("reading").alias("_kept"))
    return shuffled(before, other, ["meter_id", "ts"], "left").where(F.col("reading").isNotNull() & F.col("_kept").isNull()).drop("_kept")


def nearest(left: DataFrame, right: DataFrame, *, tolerance: float = 300.0, value: str = "reading") -> DataFrame:
    """Each left row with the nearest right row of its meter in time, within ``tolerance`` seconds; of two equally near, the earlier, and of several at one time, that of the largest value.

    Both sides are merged and sorted once by meter and time, and the last and next right row are
    carried to each left row: no pairs are formed.
    """
    mine = left.select("meter_id", "ts", F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema["ts"].dataType).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    theirs = right.select("meter_id", "ts", F.lit(1).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col("ts").alias("_t"), F.col(value).alias("_v"))
    found = F.when(F.col("_side") == 1, F.struct("_t", "_v"))

    def seen(*order) -> Column:
        """The last right row up to here; the next one is the last seen from the end, so that frames only grow."""
        return F.last(found, ignorenulls=True).over(Window.partitionBy("meter_id").orderBy(*order, F.desc("_side"), "_v").rowsBetween(Window.unboundedPreceding, 0))

    both = mine.unionByName(theirs).withColumns({"_last": seen("ts"), "_next": seen(F.desc("ts"))})
    back, ahead = seconds(F.col("ts")) - seconds(F.col("_last._t")), seconds(F.col("_next._t")) - seconds(F.col("ts"))
    rows = both.where("_side = 0").withColumns({"_back": F.when(back <= tolerance, back), "_ahead": F.when(ahead <= tolerance, ahead)})
    pick = F.when(F.col("_back").isNotNull() & (F.col("_ahead").isNull() | (F.col("_back") <= F.col("_ahead"))), F.col("_last")).when(F.col("_ahead").isNotNull(), F.col("_next"))
    return rows.withColumn("_pick", pick).select("_row.*", F.col("_pick._t").alias("nearest_ts"), F.col("_pick._v").alias(f"nearest_{value}"))


def interval_sums(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """For each actual row but a meter's first, the sum of predictions after the actual before and up to it; rows without any are left out.

    Each prediction finds the actual that ends its interval by a window over both in order.
    """
    # from the end: at one time, the actual comes before the predictions that it ends
    each = Window.partitionBy("meter_id").orderBy(F.desc("ts"), F.desc("_side"))
    ends = actual.select("meter_id", "ts", F.lit(1).alias("_side"), F.col("diff"), F.lit(None).cast("double").alias("predicted"))
    inner = predicted.select("meter_id", "ts", F.lit(0).alias("_side"), F.lit(None).cast("double").alias("diff"), "predicted")
    both = ends.unionByName(inner)
    end = F.last(F.when(F.col("_side") == 1, F.col("ts")), ignorenulls=True).over(each.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("_side") == 1, F.col("ts"))).over(Window.partitionBy("meter_id"))
    placed = both.withColumns({"_end": end, "_first": first}).where(F.col("_end") > F.col("_first"))
    return placed.groupBy("meter_id", F.col("_end").alias("ts")).agg(F.max("diff").alias("actual"), F.sum("predicted").alias("predicted"), F.count("predicted").alias("n_predicted")).where("n_predicted > 0")
