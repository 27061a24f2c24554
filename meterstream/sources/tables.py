"""Readers and writers of deliveries, series, metadata, models and results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import local_to_utc, parsed_local
from ..functions.columns import number, renamed
from ..operators.joins import clustered, shuffled

#: Names that deliveries use, and ours.
CANONICAL = {"id": "meter_id", "timestamp": "ts_local", "hodnota": "reading", "VAR_ID": "meter_id", "Time of reading": "ts_local", "Value": "reading", "Diff.": "diff", "Diff": "diff", "timestamp_utc": "ts"}


def read_delivery(spark: SparkSession, path: str, *, separator: str = ";", pattern: str = "*.csv") -> DataFrame:
    """Raw deliveries in a folder and below it: ``meter_id, ts_local, reading`` with an ordinal in file order, unreadable values null."""
    raw = spark.read.option("sep", separator).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)
    rows = renamed(raw, {c: CANONICAL[c] for c in raw.columns if c in CANONICAL})
    required(rows, "meter_id", "ts_local", "reading")
    return rows.select(F.col("meter_id").try_cast("long").alias("meter_id"), parsed_local(F.col("ts_local")).alias("ts_local"), number(F.col("reading")).alias("reading"), F.monotonically_increasing_id().alias("ordinal"))


def read_series(spark: SparkSession, path: str, *, pattern: str = "*.csv", key: str = "long") -> DataFrame:
    """Files of one meter each (or of one of its years), named by the meter, or in folders ``meter_id=...``, or files of many meters that name theirs in each row; paths may hold globs."""
    raw = spark.read.option("header", True).option("pathGlobFilter", pattern).csv(path)
    rows = renamed(raw, {c: CANONICAL[c] for c in raw.columns if c in CANONICAL and c != "id"})
    required(rows, "reading")
    named = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:-\d{4})?\.csv$", 1)
    return rows.withColumn("meter_id", (F.col("meter_id").cast("string") if "meter_id" in rows.columns else named).try_cast(key)).withColumn("reading", number(F.col("reading")))


def read_segment(spark: SparkSession, path: str, *, zone: str = "Europe/Prague", key: str = "long") -> DataFrame:
    """Segments with local times: ``meter_id, ts, reading`` in UTC, rows without a time left out.

    Rows come in the order of their files, which tells repeated local times apart.
    """
    rows = read_series(spark, path, key=key)
    required(rows, "ts_local")
    ordered = rows.withColumns({"ts_local": parsed_local(F.col("ts_local")), "ordinal": F.monotonically_increasing_id()})
    return local_to_utc(ordered, zone).where(F.col("ts_utc").isNotNull()).select("meter_id", F.col("ts_utc").alias("ts"), "reading")


def required(rows: DataFrame, *names: str) -> None:
    """Raise for missing columns, and name those there are."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing {missing}; there are {rows.columns}")


def read_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One key of all metadata files."""
    return spark.read.json(path).select("meter_id", key)


def write_metadata(facts: DataFrame, path: str) -> None:
    """A JSON object for each meter; missing values are left out."""
    facts.write.json(path)


def augmented(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Facts with the values of ``more`` where it has some; columns and meters that only one side has are kept."""
    own, new = [c for c in facts.columns if c != "meter_id"], [c for c in more.columns if c != "meter_id"]
    a, b = facts.alias("a"), more.alias("b")
    columns = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in own and c in new else F.col(f"a.{c}" if c in own else f"b.{c}") for c in [*own, *sorted(set(new) - set(own))]]
    return a.join(b, F.col("a.meter_id").eqNullSafe(F.col("b.meter_id")), "full").select(F.coalesce("a.meter_id", "b.meter_id").alias("meter_id"), *columns)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """The rows of all shards; columns that a shard lacks are null. Order comes from the times, as shards have none."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def computed_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written there if there is none yet; one that a failed writer left is made anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_results(results: DataFrame, path: str, *, scores: str = "z_scores") -> None:
    """One row for each meter as ``results``, and flat ``scores``: a row for each meter and step of its array of scores."""
    results.drop(scores).write.parquet(f"{path}/results")
    results.select("meter_id", F.posexplode(scores).alias("step", "z_score")).write.parquet(f"{path}/scores")


def write_predictions(records: DataFrame, summary: DataFrame, path: str) -> None:
    """Records in files of whole meters, and the summary that stands beside them."""
    clustered(records).write.parquet(f"{path}/predictions")
    summary.write.parquet(f"{path}/summary")


def write_segments(rows: DataFrame, starts: DataFrame, path: str) -> DataFrame:
    """Segments in files of whole meters (rows with ``start``) and their manifest, which is returned: for every meter asked for its first and last time, rows, and status, ``no_window`` where it has none."""
    clustered(rows).write.parquet(f"{path}/segments")
    made = rows.groupBy("meter_id").agg(F.min("start").alias("start"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"))
    manifest = shuffled(starts.select("meter_id").distinct(), made, "meter_id", "left").fillna(0, ["n_rows"]).withColumn("status", F.when(F.col("n_rows") > 0, "success").otherwise("no_window"))
    manifest.write.parquet(f"{path}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")


def as_json(records: DataFrame) -> DataFrame:
    """Each record as a line of JSON, nulls included: for a console, a file or a queue."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def successes(results: DataFrame) -> DataFrame:
    return results.where("status = 'success'")


def write_models(models: DataFrame, path: str) -> None:
    """The model table, committed as a whole."""
    models.write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def synthetic_series(spark: SparkSession, meters: int, *, days: int = 90, steps: int = 48, seed: int = 42) -> DataFrame:
    """Made-up consumption: a daily wave with three peaks, a weekday factor, noise and still nights, added up from 1000."""
    slots = spark.range(meters).select(F.col("id").alias("meter_id"), F.explode(F.sequence(F.lit(0), F.lit(days * steps - 1))).alias("k"))
    hour = (F.col("k") % steps) * (24.0 / steps)

    def peak(at: float, height: float, width: float):
        return height * F.exp(-F.pow((hour - at) / width, 2) / 2)

    weekday = F.weekday(F.date_add(F.lit("2025-01-01").cast("date"), F.floor(F.col("k") / steps).cast("int")))
    noise = (F.pmod(F.xxhash64("meter_id", "k", F.lit(seed)), F.lit(2001)) - 1000) / 10000.0
    flow = (0.3 + 0.1 * F.sin(2 * 3.141592653589793 * hour / 24) + peak(7, 0.8, 1) + peak(12, 0.4, 1.5) + peak(19, 1.0, 1.5)) * F.when(weekday >= 5, 1.2).otherwise(1.0) + noise
    diff = F.when((hour >= 1) & (hour < 5), 0.0).otherwise(F.greatest(flow, F.lit(0.0)))
    ts = F.timestamp_micros((F.unix_timestamp(F.lit("2025-01-01 00:00:00")) + F.col("k") * (86400 // steps)) * 1_000_000)
    from pyspark.sql.window import Window

    total = F.sum("diff").over(Window.partitionBy("meter_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return slots.select("meter_id", ts.alias("ts"), diff.alias("diff")).withColumn("reading", 1000 + total)
