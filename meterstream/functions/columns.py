"""Column functions on increments, residuals and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A meter may run back by less than this without counting as a reset.
NOISE = 0.002


def clean_increment(diff: Column, noise: float = NOISE, null_as_zero: bool = False) -> Column:
    """Increments of at most ``-noise`` become null and smaller negative ones 0; with ``null_as_zero``, missing ones become 0 first."""
    value = F.coalesce(diff, F.lit(0.0)) if null_as_zero else diff
    return F.when(value <= -noise, F.lit(None)).when(value < 0, F.lit(0.0)).otherwise(value)


def residual(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def at_least_zero(value: Column) -> Column:
    """The value, or 0 for a negative one; null stays null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def number(text: Column) -> Column:
    """Text as a finite double; null for blank, ``nan``, ``none``, ``null``, infinite and unreadable ones."""
    parsed = F.nullif(F.lower(F.trim(text)), F.lit("")).try_cast("double")
    return F.when(F.isnan(parsed) | F.abs(parsed).isin(float("inf")), F.lit(None)).otherwise(parsed)


def numbers(df: DataFrame, *names: str) -> DataFrame:
    """Columns as finite doubles by ``number``; a column that is missing is added as nulls."""
    return df.withColumns({n: number(F.col(n).cast("string")) if n in df.columns else F.lit(None).cast("double") for n in names})


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename to canonical names; a column that already has one of these is dropped first."""
    clashing = [new for old, new in names.items() if new != old and new in df.columns]
    return df.drop(*clashing).withColumnsRenamed(names)


def metric_columns(columns: list[str], resampled: bool = True, nonzero: bool = False) -> list[str]:
    """Names of metric columns, by prefix and suffix; the counts go with the non-zero twins."""
    prefix = "metric_" if resampled else "unresampled_metric_"
    own = [c for c in columns if c.startswith(prefix)]
    return [c for c in own if c.endswith("_nz") or c.endswith("_count")] if nonzero else [c for c in own if not c.endswith("_nz")]


def flag(z: Column, threshold: float) -> Column:
    """1 where the score is beyond the threshold on either side; 0 where there is none."""
    return F.coalesce(F.abs(z) > threshold, F.lit(False)).cast("int")
