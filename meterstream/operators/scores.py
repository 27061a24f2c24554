"""Reference statistics, z-scores, flags and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least_zero, flag

SCALE = 1.4826


def _center(rows: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """Mean, sample deviation (0 of a single value), median and median absolute deviation by key."""
    some = rows.where(F.col(value).isNotNull())
    first = some.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}mean"), F.when(F.count("*") == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias(f"{prefix}std"), F.expr(f"percentile({value}, 0.5)").alias(f"{prefix}median"), F.count("*").alias(f"{prefix}n")
    )
    second = some.join(first.select(*keys, f"{prefix}median"), keys).groupBy(*keys).agg(F.expr(f"percentile(abs({value} - {prefix}median), 0.5)").alias(f"{prefix}mad"))
    return first.join(second, keys)


def global_stats(reference: DataFrame, value: str = "residual") -> DataFrame:
    """``global_mean, global_std, global_median, global_mad`` of each meter."""
    return _center(reference, ["meter_id"], value, "global_").drop("global_n")


def position_stats(reference: DataFrame, steps: Column, k: Column, value: str = "residual") -> DataFrame:
    """Statistics at each position over the ``k`` positions on either side, around the day.

    Where the neighbourhood is longer than the day, a position counts as often as it is met.
    """
    spread = reference.withColumn("position", F.explode(F.transform(F.sequence(-k, k), lambda o: F.pmod(F.col("position") + o, steps))))
    return _center(spread, ["meter_id", "position"], value)


def z_scores(rows: DataFrame, at: DataFrame, over_all: DataFrame, value: str = "residual") -> DataFrame:
    """Add ``z_score`` and ``z_score_robust`` against a position's statistics, and the meter's where it has none or no spread.

    A robust score without median deviation is measured by the standard deviation; without any
    spread a score is 0; a null value or an empty reference gives null.
    """
    joined = rows.join(at, ["meter_id", "position"], "left").join(over_all, "meter_id", "left")
    mean = F.when(F.col("std") > 0, F.col("mean")).otherwise(F.col("global_mean"))
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(F.col("global_std"))
    own = F.col("mad") > 0
    median = F.when(own, F.col("median")).otherwise(F.col("global_median"))
    wide = F.when(own, SCALE * F.col("mad")).when(F.col("global_mad") > 0, SCALE * F.col("global_mad")).otherwise(F.col("global_std"))
    return joined.withColumns({"mu": mean, "sd": std, "robust_mu": median, "robust_sd": wide}).withColumns({"z_score": score(F.col(value), F.col("mu"), F.col("sd")), "z_score_robust": score(F.col(value), F.col("robust_mu"), F.col("robust_sd"))}).drop(
        "mean", "std", "median", "mad", "n", "global_mean", "global_std", "global_median", "global_mad"
    )


def score(value: Column, mu: Column, sd: Column) -> Column:
    return F.when(sd == 0, F.when(value.isNotNull(), F.lit(0.0))).otherwise((value - mu) / sd)


def floored(sd: Column, global_sd: Column, typical: Column, share: float = 0.25, of_global: float = 0.3) -> Column:
    """A deviation that doesn't fall below a share of the meter's own and of its typical non-zero increment; missing bounds don't count."""
    return F.greatest(sd, of_global * global_sd, share * typical)


def flags_and_bands(scored: DataFrame, *, threshold: float = 3.0, robust_threshold: float = 3.0) -> DataFrame:
    """Add flags by both scores, the truth (a non-zero injected change), and bands around the prediction, the lower ones not below 0."""
    wide, robust = F.col("mu") + threshold * F.col("sd"), F.col("robust_mu") + robust_threshold * F.col("robust_sd")
    return scored.withColumns(
        {
            "is_anomaly_actual": (F.coalesce("is_anomaly", F.lit(0.0)) != 0).cast("int"),
            "is_anomaly_predicted": flag(F.col("z_score"), threshold),
            "is_anomaly_robust_predicted": flag(F.col("z_score_robust"), robust_threshold),
            "upper_band": F.col("predicted") + wide,
            "lower_band": at_least_zero(F.col("predicted") - wide),
            "upper_band_robust": F.col("predicted") + robust,
            "lower_band_robust": at_least_zero(F.col("predicted") - robust),
        }
    )
