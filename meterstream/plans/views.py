"""Meter views of the driver's tables, and the same in SQL."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hourly meters by event type: consumption in whole hundredths, so that sums are exact, and the running reading.
HOURLY = """
    h AS (SELECT event_type AS meter_id, date_trunc('hour', ts) AS ts, sum(floor(value * 100 + 0.5)::BIGINT) AS units FROM events GROUP BY 1, 2),
    m AS (SELECT meter_id, ts, units / 100.0::DOUBLE AS diff, (sum(units) OVER (PARTITION BY meter_id ORDER BY ts))::DOUBLE / 100.0::DOUBLE AS reading FROM h)
"""
#: The hour before's consumption as a forecast, and a mark on every 13th hour of the epoch as an anomaly.
PAIRS = HOURLY + """,
    p AS (SELECT * FROM (SELECT meter_id, ts, diff AS actual, lag(diff) OVER (PARTITION BY meter_id ORDER BY ts) AS predicted, CASE WHEN (epoch(ts)::BIGINT // 3600) % 13 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_anomaly, hour(ts)::INT AS position FROM m) WHERE predicted IS NOT NULL),
    s AS (SELECT *, abs(actual - predicted) AS residual FROM p)
"""

#: Ten days of hourly readings of a meter for each supplier: quiet nights, steps that are flat now and then, increments in eighths, and no reading at every 50th hour.
PATTERNED = """
    k AS (SELECT s_suppkey AS meter_id, k, TIMESTAMP '2024-03-01' + to_hours(k::INT) AS ts, CASE WHEN k % 24 < 5 THEN 0 ELSE ((s_suppkey * 7 + (k // 2) * 13) % 40) / 8.0::DOUBLE END AS diff FROM supplier, range(240) AS r(k)),
    m AS (SELECT meter_id, k, ts, diff, 100.0::DOUBLE + sum(diff) OVER (PARTITION BY meter_id ORDER BY k) AS total FROM k),
    pm AS (SELECT meter_id, k, ts, diff, CASE WHEN k % 50 = 49 THEN NULL ELSE total END AS reading FROM m)
"""
#: The same with three hours of the day missing, a late reading each day (within the tolerance) and one too many.
GAPPY = PATTERNED + """,
    gm AS (SELECT meter_id, k, ts + CASE WHEN k % 24 = 13 THEN INTERVAL 2 MINUTE ELSE INTERVAL 0 MINUTE END AS ts, diff, reading FROM pm WHERE k % 24 NOT IN (3, 10, 17)
           UNION ALL SELECT meter_id, k, ts + INTERVAL 20 MINUTE, diff, reading FROM pm WHERE k % 24 = 20)
"""
#: A forecast by the day before, on the pattern; residuals are twice the distance, and missing at every 31st hour.
DAY_BEFORE = PATTERNED + """,
    s AS (SELECT meter_id, ts, CASE WHEN k % 50 = 49 THEN NULL ELSE diff END AS actual, CASE WHEN k % 37 = 5 THEN 'NaN'::DOUBLE ELSE lag(diff, 24) OVER (PARTITION BY meter_id ORDER BY k) END AS predicted,
                 CASE WHEN k % 31 = 0 THEN NULL ELSE 2 * abs(diff - lag(diff, 24) OVER (PARTITION BY meter_id ORDER BY k)) END AS residual FROM pm)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_meters(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """``meter_id, ts, diff, reading`` by hour."""
    events = table(spark, sf_dir, "events")
    units = F.floor(F.col("value") * 100 + 0.5).cast("long")
    hours = events.groupBy(F.expr(key).alias("meter_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(units).alias("units"))
    each = Window.partitionBy("meter_id").orderBy("ts")
    return hours.select("meter_id", "ts", (F.col("units") / 100.0).alias("diff"), (F.sum("units").over(each) / 100.0).alias("reading"))


#: Rows made up in one task.
ROWS_A_TASK = 100_000


def dealt_meters(spark: SparkSession, sf_dir: str, rows_each: int) -> DataFrame:
    """A meter for each supplier as ``meter_id``, with ``s_acctbal``, dealt by meter to tasks that make up ``ROWS_A_TASK`` rows at ``rows_each`` a meter.

    Made-up rows pack so well that tasks put together by their bytes would hold ever more of them;
    what goes by meter next needs no other shuffle.
    """
    suppliers = table(spark, sf_dir, "supplier")
    tasks = max(ceil(suppliers.count() * rows_each / ROWS_A_TASK), spark.sparkContext.defaultParallelism)
    return suppliers.select(F.col("s_suppkey").alias("meter_id"), "s_acctbal").repartition(tasks, "meter_id")


def patterned_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``meter_id, k, ts, diff, reading`` of ``PATTERNED``."""
    hours = dealt_meters(spark, sf_dir, 240).select("meter_id", F.explode(F.sequence(F.lit(0), F.lit(239))).alias("k"))
    diff = F.when(F.col("k") % 24 < 5, 0.0).otherwise((F.col("meter_id") * 7 + F.floor(F.col("k") / 2) * 13) % 40 / 8.0)
    rows = hours.select("meter_id", "k", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + F.col("k") * 3600).alias("ts"), diff.alias("diff"))
    total = 100 + F.sum("diff").over(Window.partitionBy("meter_id").orderBy("k"))
    return rows.withColumn("reading", total).withColumn("reading", F.when(F.col("k") % 50 != 49, F.col("reading")))


def gappy_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``GAPPY``."""
    rows = patterned_meters(spark, sf_dir)
    hour = F.col("k") % 24
    times = F.when(hour == 13, F.array(F.col("ts") + F.expr("INTERVAL 2 MINUTE"))).when(hour == 20, F.array("ts", F.col("ts") + F.expr("INTERVAL 20 MINUTE"))).otherwise(F.array("ts"))
    return rows.where(~hour.isin(3, 10, 17)).select("meter_id", "k", F.explode(times).alias("ts"), "diff", "reading")


def day_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``DAY_BEFORE``."""
    guess = F.lag("diff", 24).over(Window.partitionBy("meter_id").orderBy("k"))
    k = F.col("k")
    return patterned_meters(spark, sf_dir).select("meter_id", "ts", F.when(k % 50 != 49, F.col("diff")).alias("actual"), F.when(k % 37 == 5, F.lit(float("nan"))).otherwise(guess).alias("predicted"), F.when(k % 31 != 0, 2 * F.abs(F.col("diff") - guess)).alias("residual"))


def forecast_pairs(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    each = Window.partitionBy("meter_id").orderBy("ts")
    rows = hourly_meters(spark, sf_dir, key).select("meter_id", "ts", F.col("diff").alias("actual"), F.lag("diff").over(each).alias("predicted"), F.when(F.floor(F.unix_timestamp("ts") / 3600) % 13 == 0, 1.0).otherwise(0.0).alias("is_anomaly"), F.hour("ts").alias("position"))
    return rows.where(F.col("predicted").isNotNull()).withColumn("residual", F.abs(F.col("actual") - F.col("predicted")))


def epoch(name: str = "ts"):
    return F.unix_timestamp(name).cast("long").alias(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some decimals, times as epoch seconds, counts as longs: what both engines print alike."""
    out = []
    for field in df.schema.fields:
        kind, c = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            out.append(F.round(c, digits).alias(field.name))
        elif kind.startswith("timestamp"):
            out.append(F.unix_timestamp(c).cast("long").alias(field.name))
        elif kind == "int":
            out.append(c.cast("long").alias(field.name))
        elif kind == "date":
            out.append(c.cast("string").alias(field.name))
        else:
            out.append(c)
    return df.select(*out)
