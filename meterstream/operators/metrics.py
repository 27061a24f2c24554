"""Forecast and detection metrics, and summaries of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import shuffled

#: The least denominator of a mean relative error (the double's machine epsilon), and what is added to one elsewhere.
EPSILON = 2.220446049250313e-16
SMALL = 1e-8


def _number(name: str) -> Column:
    """A column as a double, NaN as null."""
    return F.nullif(F.col(name).cast("double"), F.lit(float("nan")))


def regression(rows: DataFrame, *keys: str, nonzero: bool = False, suffix: str = "") -> DataFrame:
    """Errors of predictions by key, over rows with actual, predicted and residual (taken as their distance where there is no such column).

    ``total_count`` and its kind are of all rows; a key without a valid row has null errors. With
    ``nonzero``, only rows whose actual isn't 0 count, keys of more than two of them are given,
    and the median relative error has nothing added to its denominator. Statistics of residuals are
    those of the column, their deviation that of a population. The direction agreement compares
    successive valid rows: whether both rise, or neither does.
    """
    rows = rows.withColumns({"actual": _number("actual"), "predicted": _number("predicted")})
    rows = rows.withColumn("residual", _number("residual") if "residual" in rows.columns else F.abs(F.col("actual") - F.col("predicted")))
    valid = F.col("actual").isNotNull() & F.col("predicted").isNotNull() & F.col("residual").isNotNull()
    rows = rows.withColumn("_ok", valid & (F.col("actual") != 0) if nonzero else valid)
    before = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    own = {name: F.when(F.col("_ok"), F.col(name)) for name in ("actual", "predicted", "residual")}
    rows = rows.withColumns({f"_{name}": c for name, c in own.items()} | {f"_{name}_before": F.last(own[name], ignorenulls=True).over(before) for name in ("actual", "predicted")})
    e, size = F.col("_actual") - F.col("_predicted"), F.abs("_actual")
    rows = rows.withColumns({"_e": e, "_ape": F.abs(e) / F.greatest(size, F.lit(EPSILON)), "_pe": e / (size + SMALL), "_small_ape": F.abs(e) / (size if nonzero else size + SMALL), "_rises": (F.col("_actual") > F.col("_actual_before")) == (F.col("_predicted") > F.col("_predicted_before"))})
    squares, spread, n = F.sum(F.col("_e") * F.col("_e")), F.var_pop("_actual"), F.count("_e")
    stats = {
        "rmse": F.sqrt(F.avg(F.col("_e") * F.col("_e"))),
        "mae": F.avg(F.abs("_e")),
        "medae": F.expr("percentile(abs(_e), 0.5)"),
        "p75_ae": F.expr("percentile(abs(_e), 0.75)"),
        "p90_ae": F.expr("percentile(abs(_e), 0.9)"),
        "r2": F.when(n >= 2, F.when(spread > 0, 1 - squares / (spread * n)).when(squares == 0, 1.0).otherwise(0.0)),
        "mape": F.avg("_ape"),
        "median_ape": F.expr("percentile(_small_ape, 0.5)"),
        "wape": F.try_divide(F.sum(F.abs("_e")), F.sum(F.abs("_actual"))),
        "mean_residual": F.avg("_residual"),
        "std_residual": F.stddev_pop("_residual"),
        "max_residual": F.max("_residual"),
        "min_residual": F.min("_residual"),
        "normalized_rmse": F.when(spread > 0, F.sqrt(F.avg(F.col("_e") * F.col("_e"))) / F.sqrt(spread)),
        "prediction_bias": F.avg(-F.col("_e")),
        "mpe": F.avg("_pe"),
        "direction_accuracy": F.avg(F.col("_rises").cast("double")),
    }
    if nonzero:
        counts = {"count": n}
    else:
        zero = F.count_if(F.col("_actual") == 0)
        counts = {"total_count": F.count("*"), "valid_count": n, "nan_count": F.count("*") - n, "valid_percentage": 100 * n / F.count("*"), "non_zero_count": n - zero, "zero_count": zero, "non_zero_percentage": F.try_divide(100 * (n - zero), n)}
    out = rows.groupBy(*keys).agg(*(c.alias(f"metric_{name}{suffix}") for name, c in (counts | stats).items()))
    return out.where(F.col(f"metric_count{suffix}") > 2) if nonzero else out


def confusion(rows: DataFrame, *keys: str, predicted: str = "is_anomaly_predicted", actual: str = "is_anomaly_actual") -> DataFrame:
    """Counts of right and wrong flags over all rows."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return rows.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"))


def detection_rates(counts: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, precision, recall and F1 from summed counts; null where a denominator is 0."""
    tp, tn, fp, fn = (F.sum(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.groupBy(*keys).agg(
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def common_meters(results: dict[str, DataFrame]) -> DataFrame:
    """Meters that every model has."""
    return reduce(lambda a, b: a.intersect(b), (df.select("meter_id") for df in results.values()))


def converged(results: DataFrame) -> DataFrame:
    """Results of meters both of whose fits have settled."""
    return results.where(F.col("converged_train") & F.col("converged_second"))


def model_summary(results: dict[str, DataFrame], metrics: list[str], *, most_mae: float | None = None, only_common: bool = True, only_converged: bool = False, most_size: float | None = None) -> DataFrame:
    """A row per metric, in the order given, with each model's mean, sample deviation and median.

    Each model's meters are filtered first (settled fits, a mean error of at most ``most_mae``);
    then those that all models still have count. Values of ``most_size`` or more are left out.
    """
    if only_converged:
        results = {name: converged(df) for name, df in results.items()}
    if most_mae is not None:
        results = {name: df.where(F.col("metric_mae") <= most_mae) for name, df in results.items()}
    parts = [df.withColumn("model", F.lit(name)).select("model", "meter_id", *metrics) for name, df in results.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    if only_common:
        rows = rows.join(common_meters(results), "meter_id", "left_semi")
    long = rows.unpivot(["model", "meter_id"], metrics, "metric", "value")
    if most_size is not None:
        long = long.where(F.abs("value") < most_size)
    stats = (F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.expr("percentile(value, 0.5)").alias("median"))
    return in_order(long.groupBy("metric").pivot("model", list(results)).agg(*stats), "metric", metrics)


def in_order(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows sorted by where a column's value stands in a list; those that aren't in it come last, by name."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(names) + 1), column)


def quantiles(rows: DataFrame, feature: str, shares: list[float], *, rows_a_bucket: int = 1_000_000) -> list[float]:
    """Exact quantiles of a column over all rows, interpolated between neighbours; none for an empty one."""
    n = rows.where(F.col(feature).isNotNull()).count()
    if not n:
        return []
    low = [int(share * (n - 1)) for share in shares]
    values = at_ranks(rows, feature, sorted({r for k in low for r in (k, min(n - 1, k + 1))}), n, rows_a_bucket=rows_a_bucket)
    return [values[k] + (values[min(n - 1, k + 1)] - values[k]) * (share * (n - 1) - k) for k, share in zip(low, shares)]


def at_ranks(rows: DataFrame, feature: str, wanted: list[int], n: int, *, rows_a_bucket: int = 1_000_000) -> dict[int, float]:
    """The values at some ranks (from 0) of a column that has ``n`` of them.

    Rough quantiles part the values into buckets, the buckets' counts tell which hold the rows
    that are asked for, and only those are looked at row by row, each in a task; equal values are
    summed before. So no task holds more than a bucket's different values.
    """
    some = rows.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias("v"))
    parts = min(10_000, max(16, n // rows_a_bucket))
    cuts = sorted(set(some.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], F.lit(20 * parts))).first()[0]))
    placed = some.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if len(cuts) <= 64 else _bucket_of(F.col("v"), cuts))
    counts = dict(placed.groupBy("bucket").count().collect())  # a row for each bucket
    first, at = {}, 0
    for bucket in sorted(counts):
        first[bucket] = at
        at += counts[bucket]
    holding = {}
    for r in wanted:
        holding.setdefault(max(b for b in first if first[b] <= r), []).append(r)
    values: dict[int, float] = {}
    up_to = F.sum("n").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.where(F.col("bucket").isin(list(holding))).groupBy("bucket", "v").agg(F.count("*").alias("n")).withColumn("last", up_to)
    asked = F.create_map(*(F.lit(x) for b, own in holding.items() for x in (b, F.array(*(F.lit(r - first[b]) for r in own)))))
    hit = F.filter(asked[F.col("bucket")], lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("n")))
    for row in ranked.select("bucket", "v", F.explode(hit).alias("r")).collect():  # a row for each rank asked for
        values[first[row["bucket"]] + row["r"]] = row["v"]
    return values


def _bucket_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts are below the value, by halving."""
    if not cuts:
        return F.lit(0)
    k = len(cuts) // 2
    return F.when(value > cuts[k], k + 1 + _bucket_of(value, cuts[k + 1 :])).otherwise(_bucket_of(value, cuts[:k]))


def quantile_bins(rows: DataFrame, feature: str, bins: int = 8) -> DataFrame:
    """Add ``bin``: which right-closed quantile interval the feature lies in (the lowest value is in the first); equal edges count once."""
    edges = sorted(set(quantiles(rows, feature, [k / bins for k in range(bins + 1)])))
    below = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>"), lambda e: e < F.col(feature)))
    return rows.withColumn("bin", F.when(F.col(feature).isNotNull(), F.greatest(below, F.lit(1))))


def quantile_profile(rows: DataFrame, feature: str, bins: int = 8) -> DataFrame:
    """By quantile bin of a feature: meters, summed ``tp, fp, fn``, and precision, recall and F1 from the sums; null where a denominator is 0."""
    sums = quantile_bins(rows.where(F.col(feature).isNotNull()), feature, bins).groupBy("bin").agg(F.count("*").alias("n"), F.min(feature).alias("low"), F.max(feature).alias("high"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    out = sums.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    good = (F.col("precision") > 0) & (F.col("recall") > 0)
    return out.withColumn("f1", F.when(good, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """Counts in equal bins from ``low`` to ``high`` (closed at the top), with bin 0 below and ``bins + 1`` above, and least, largest, mean and population deviation of the values in each."""
    width = (high - low) / bins
    v = F.col(value)
    bin_ = F.when(v < low, 0).when(v > high, bins + 1).otherwise(F.least(F.floor((v - low) / width) + 1, F.lit(bins)))
    return rows.where(v.isNotNull()).groupBy(*keys, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def value_box(rows: DataFrame, value: str, *keys: str, beyond: float = 3.0) -> DataFrame:
    """Least, largest, mean, population deviation and kurtosis (3 for a normal law) of a value by key, and the share of rows beyond a size."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.kurtosis(v) + 3).alias("kurtosis"), F.avg((F.abs(v) > beyond).cast("double")).alias("beyond"))


def intermittency(rows: DataFrame, value: str = "diff", zero: float = 0.0) -> DataFrame:
    """Average distance between values above ``zero`` (infinite without any), their squared variation (deviation of a sample, 0 of a single one), counts and share, by meter; missing values are no periods."""
    v = _number(value)
    some, hits, own = F.count(v), F.count_if(v > zero), F.when(v > zero, v)
    spread = F.when(hits == 1, 0.0).otherwise(F.stddev_samp(own))
    return rows.groupBy("meter_id").agg(
        F.when(some == 0, F.lit(None)).when(hits == 0, F.lit(float("inf"))).otherwise(some / F.nullif(hits, F.lit(0))).alias("adi"), F.pow(F.try_divide(spread, F.avg(own)), 2).alias("cv2"), some.alias("n_periods"), hits.alias("n_nonzero"), F.try_divide(hits, some).alias("nonzero_fraction")
    )


def scaled_errors(rows: DataFrame, season: int, *, trained: DataFrame | None = None) -> DataFrame:
    """Mean absolute error over that of repeating the value before, and the value a season before."""
    base = trained if trained is not None else rows.select("meter_id", "ts", F.col("actual").alias("diff"))
    each = Window.partitionBy("meter_id").orderBy("ts")
    naive = base.withColumns({"_1": F.abs(F.col("diff") - F.lag("diff").over(each)), "_m": F.abs(F.col("diff") - F.lag("diff", season).over(each))}).groupBy("meter_id").agg(F.avg("_1").alias("_1"), F.avg("_m").alias("_m"))
    mae = rows.groupBy("meter_id").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    return mae.join(naive, "meter_id", "left").select("meter_id", "mae", F.try_divide("mae", "_1").alias("mase_naive"), F.try_divide("mae", "_m").alias("mase_seasonal"))


def _acf(x: np.ndarray, most: int) -> np.ndarray | None:
    """Autocorrelations of lag 1 to ``most``; none for fewer than twice as many values or without variance."""
    x = x[np.isfinite(x)]
    if most < 1 or len(x) < 2 * most or len(x) < 2:
        return None
    x = x - x.mean()
    size = 1 << int(2 * len(x) - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)) ** 2
    sums = np.fft.irfft(power, size)[: most + 1]
    return sums[1:] / sums[0] if sums[0] > 0 and np.ptp(x) > 0 else None


def autocorrelation(rows: DataFrame, most: int, value: str = "diff") -> DataFrame:
    """Autocorrelation of each meter up to ``most`` steps, by one transform of its rows in time; none for a meter of fewer than twice as many rows or without variance."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = _acf(group.sort_values("ts", kind="stable")[value].to_numpy(float), most)
        n = 0 if found is None else most
        return pd.DataFrame({"meter_id": [group["meter_id"].iloc[0]] * n, "lag": np.arange(1, n + 1), "acf": found if n else []})

    return rows.select("meter_id", "ts", F.col(value).cast("double").alias(value)).groupBy("meter_id").applyInPandas(run, f"meter_id {rows.schema['meter_id'].dataType.simpleString()}, lag long, acf double")


def autocorrelation_facts(rows: DataFrame, facts: DataFrame, value: str = "diff", seconds: float = 7 * 86400) -> DataFrame:
    """By meter, over the lags that a week of its ``period`` holds: the autocorrelation of largest size and its lag, their mean and population deviation; nulls where there is none."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        period = group["period"].iloc[0]
        found = _acf(group.sort_values("ts", kind="stable")[value].to_numpy(float), int(seconds // period) if period > 0 else 0)
        k = int(np.abs(found).argmax()) if found is not None else None
        out = {"max_autocorr": found[k], "max_autocorr_lag": k + 1, "autocorr_mean": found.mean(), "autocorr_std": found.std()} if found is not None else dict.fromkeys(("max_autocorr", "max_autocorr_lag", "autocorr_mean", "autocorr_std"))
        return pd.DataFrame([{"meter_id": group["meter_id"].iloc[0]} | out]).astype({"max_autocorr_lag": object})

    joined = shuffled(rows.select("meter_id", "ts", F.col(value).cast("double").alias(value)), facts.select("meter_id", F.col("period").cast("double").alias("period")), "meter_id")
    return joined.groupBy("meter_id").applyInPandas(run, f"meter_id {rows.schema['meter_id'].dataType.simpleString()}, max_autocorr double, max_autocorr_lag long, autocorr_mean double, autocorr_std double")


def with_normality(rows: DataFrame, name: str, n: str, skewness: str, kurtosis: str) -> DataFrame:
    """Add the probability of skewness and excess kurtosis at least as far from a normal law's in ``n`` values (D'Agostino and Pearson); null below 8.

    Step by step, as each is used more than once by the next.
    """
    count, skew, tails = F.col(n).cast("double"), F.col(skewness), F.col(kurtosis)
    y = skew * F.sqrt((count + 1) * (count + 3) / (6.0 * (count - 2)))
    beta = 3.0 * (count * count + 27 * count - 70) * (count + 1) * (count + 3) / ((count - 2.0) * (count + 5) * (count + 7) * (count + 9))
    spread = 24.0 * count * (count - 2) * (count - 3) / ((count + 1) * (count + 1) * (count + 3.0) * (count + 5))
    third = 6.0 * (count * count - 5 * count + 2) / ((count + 7.0) * (count + 9)) * F.sqrt(6.0 * (count + 3) * (count + 5) / (count * (count - 2.0) * (count - 3)))
    many = lambda c: F.when(count >= 8, c)
    out = rows.withColumns({"_w2": many(-1 + F.sqrt(2 * (beta - 1))), "_third": many(third), "_x": many((tails + 3 - 3.0 * (count - 1) / (count + 1)) / F.sqrt(spread))})
    w2, third, x = F.col("_w2"), F.col("_third"), F.col("_x")
    out = out.withColumns({"_y": many(y / F.sqrt(2 / (w2 - 1))), "_a": 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))})
    y, a = F.col("_y"), F.col("_a")
    lower = 1 + x * F.sqrt(2 / (a - 4))
    out = out.withColumns({"_by_skew": F.log(y + F.sqrt(y * y + 1)) / F.sqrt(0.5 * F.log(w2)), "_cube": F.signum(lower) * F.pow((1 - 2 / a) / F.abs(lower), 1 / 3.0)})
    by_tails = (1 - 2 / (9 * a) - F.col("_cube")) / F.sqrt(2 / (9 * a))
    return out.withColumn(name, F.exp(-0.5 * (F.col("_by_skew") * F.col("_by_skew") + by_tails * by_tails))).drop("_w2", "_third", "_x", "_y", "_a", "_by_skew", "_cube")


def filter_metrics(rows: DataFrame, *, nonzero_above: float = 0.0, tiny: float = 1e-10) -> DataFrame:
    """Quality of a filter's run by meter, from ``actual, predicted, filtered, innovation, innovation_var`` and, where there is one, ``flagged``.

    Errors of predictions and of filtered values, over all rows and (``_nonzero``) over those of
    some size; how much smoother the filtered values are; whether innovations look like white
    noise; what stands out at flagged rows; how steady the gain and the variance are. Variances are
    those of a population, and ``tiny`` is added to denominators.
    """
    each = Window.partitionBy("meter_id").orderBy("ts")
    earlier = each.rowsBetween(Window.unboundedPreceding, -1)
    big = F.abs("actual") > nonzero_above
    flagged = F.coalesce(F.col("flagged").cast("boolean"), F.lit(False)) if "flagged" in rows.columns else F.lit(False)
    rows = rows.withColumns(
        {
            "_p": F.col("actual") - F.col("predicted"),
            "_f": F.col("actual") - F.col("filtered"),
            "_s": F.abs(F.col("innovation") / F.sqrt(F.col("innovation_var"))),
            "_gain": F.try_divide(F.col("filtered") - F.col("predicted"), F.col("innovation")),
            "_flagged": flagged,
            "_innovation": F.lag("innovation").over(each),
            "_filtered": F.lag("filtered").over(each),
            "_da": F.col("actual") - F.lag("actual").over(each),
            "_df": F.col("filtered") - F.lag("filtered").over(each),
            "_da_nz": F.when(big, F.col("actual") - F.last(F.when(big, F.col("actual")), ignorenulls=True).over(earlier)),
            "_df_nz": F.when(big, F.col("filtered") - F.last(F.when(big, F.col("filtered")), ignorenulls=True).over(earlier)),
        }
    )

    def errors(name: str, column: str, suffix: str, where: Column) -> dict[str, Column]:
        e = F.when(where, F.col(column))
        square = F.sum(e * e)
        own = F.when(where, F.col("actual"))
        out = {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "me": F.avg(e), "medae": F.percentile(F.abs(e), F.lit(0.5))}
        if name == "prediction" or suffix:
            out["r2"] = 1 - square / (F.var_pop(own) * F.count(own) + tiny)
        return {f"{name}_{k}{suffix}": c for k, c in out.items()}

    def smoothing(suffix: str, where: Column, da: str, df: str) -> dict[str, Column]:
        a, f = F.when(where, F.col("actual")), F.when(where, F.col("filtered"))
        ma, mf = F.coalesce(F.var_pop(da), F.lit(0.0)), F.coalesce(F.var_pop(df), F.lit(0.0))
        return {f"measurement_variance{suffix}": F.var_pop(a), f"filtered_variance{suffix}": F.var_pop(f), f"variance_ratio{suffix}": F.var_pop(f) / (F.var_pop(a) + tiny), f"measurement_smoothness{suffix}": ma, f"filtered_smoothness{suffix}": mf, f"smoothness_gain{suffix}": (ma - mf) / (ma + tiny), f"filter_corr{suffix}": F.corr(a, f)}

    every = F.lit(True)
    autocorr = F.corr("innovation", "_innovation")
    at, off = F.avg(F.when(F.col("_flagged"), F.abs("_f"))), F.avg(F.when(~F.col("_flagged"), F.abs("_f")))
    stats = (
        {"n": F.count("*"), "n_nonzero": F.count_if(big), "nonzero_pct": 100 * F.avg(big.cast("double"))}
        | errors("prediction", "_p", "", every)
        | {"prediction_mape": 100 * F.avg(F.abs(F.col("_p") / (F.col("actual") + tiny))), "prediction_nrmse": F.sqrt(F.avg(F.col("_p") * F.col("_p"))) / (F.stddev_pop("actual") + tiny)}
        | errors("filtered", "_f", "", every)
        | smoothing("", every, "_da", "_df")
        | {"filtered_autocorr": F.corr("filtered", "_filtered")}
        | errors("prediction", "_p", "_nonzero", big)
        | errors("filtered", "_f", "_nonzero", big)
        | smoothing("_nonzero", big, "_da_nz", "_df_nz")
        | {"innovation_mean": F.avg("innovation"), "innovation_std": F.stddev_pop("innovation"), "innovation_skew": F.skewness("innovation"), "innovation_kurtosis": F.kurtosis("innovation"), "innovation_autocorr": autocorr, "_n": F.count("innovation")}
        | {"n_flagged": F.count_if("_flagged"), "flagged_pct": 100 * F.avg(F.col("_flagged").cast("double")), "mae_at_flagged": at, "mae_elsewhere": off, "suppression_ratio": at / (off + tiny), "score_at_flagged": F.avg(F.when(F.col("_flagged"), F.col("_s"))), "max_score": F.max("_s")}
        | {f"gain_{n}": f("_gain") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))}
        | {"gain_steady": F.stddev_pop("_gain") < 0.1}
        | {f"variance_{n}": f("innovation_var") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))}
        | {"variance_steady": F.max("innovation_var") / (F.min("innovation_var") + tiny) < 10}
    )
    out = with_normality(rows.groupBy("meter_id").agg(*(c.alias(name) for name, c in stats.items())), "innovation_normality", "_n", "innovation_skew", "innovation_kurtosis").drop("_n")
    return out.withColumn("innovation_white", (F.abs("innovation_autocorr") < 0.1) & (F.col("innovation_normality") > 0.05))


GATES = {"initial": (10.0, 0.5, 0.95), "retrain": (15.0, 0.6, 1.0)}


def quality_gate(rows: DataFrame, kind: str = "initial") -> DataFrame:
    """Add ``passed`` and ``reasons``: share filled, seasonal strength and scaled error against a gate's bounds; a missing value fails."""
    fill, strength, error = GATES[kind]

    def unless(good: Column, name: str) -> Column:
        return F.when(~F.coalesce(good, F.lit(False)), F.lit(name))

    reasons = F.array_compact(F.array(unless(F.col("fill_pct") < fill, "fill"), unless(F.col("f_s") > strength, "seasonality"), unless(F.col("mase") < error, "mase")))
    return rows.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def failure_reasons(rows: DataFrame, most: int = 5) -> DataFrame:
    """The commonest reasons of failed meters, by the text before a colon."""
    return rows.where("status != 'success'").groupBy(F.trim(F.split_part("error", F.lit(":"), F.lit(1))).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def compared(results: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Each metric of a meter under every model, a column each, for meters that any has."""
    parts = [df.select("meter_id", *names).unpivot("meter_id", names, "metric", model) for model, df in results.items()]
    return reduce(lambda a, b: a.join(b, ["meter_id", "metric"], "full"), parts)


def batch_totals(results: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """Meters by outcome and what their grids gained, over all; with ``unmatched``, the readings that grids left out as well."""
    good = F.col("n_after") > 0
    out = results.agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_success"), F.count_if(~F.coalesce(good, F.lit(False))).alias("n_failed"), F.sum("n_before").alias("rows_before"), F.sum("n_after").alias("rows_after"), F.sum("n_made_up").alias("rows_made_up"), F.avg("fill_pct").alias("mean_fill_pct")
    )
    return out if unmatched is None else out.join(unmatched.agg(F.count("*").alias("n_unmatched")))  # one row each


def innovation_diagnostics(rows: DataFrame, most: int = 30) -> DataFrame:
    """Mean and deviation of innovations by meter, their quantiles, how many autocorrelations leave the band of noise, and its half width."""
    some = rows.where(F.col("innovation").isNotNull())
    acf = autocorrelation(some.withColumnRenamed("innovation", "diff").select("meter_id", "ts", "diff"), most)
    base = some.groupBy("meter_id").agg(F.avg("innovation").alias("mean"), F.stddev_pop("innovation").alias("std"), F.expr("percentile(innovation, array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("q"), (1.96 / F.sqrt(F.count("*"))).alias("band"))
    out = shuffled(base, acf, "meter_id", "left").groupBy("meter_id", "mean", "std", "q", "band").agg(F.count_if(F.abs("acf") > F.col("band")).alias("n_outside"))
    return out.select("meter_id", "mean", "std", "band", "n_outside", *(F.col("q")[k].alias(f"q{p}") for k, p in enumerate((5, 25, 50, 75, 95))))
