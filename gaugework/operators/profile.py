"""Per-metric distribution profile on non-zero values, overview and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.scalars import (
    non_zero,
    percentage,
    present,
    quoted,
    sample_kurtosis,
    sample_skewness,
)
from gaugework.operators import quantiles as Q
from gaugework.operators.joins import join_keys
from gaugework.sources.metrics import METRIC, VALUE, MetricFrame

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)

MOMENTS = ("all_rows", "total_records", "n", "mean", "std_dev", "g1", "g2", "min", "max")
# Above this many metrics their aggregates no longer fit one generated method.
WIDE_LIMIT = 8

PROFILE_FIELDS = (
    "metric_name", "mean", "median", "std_dev", "skewness", "kurtosis", "min", "max",
    "p05", "p25", "p75", "p95", "iqr", "null_count", "null_percentage",
    "non_zero_records", "zero_count", "zero_percentage", "total_records",
)


def profile(
    data: MetricFrame | DataFrame,
    keys: Sequence[str] = (METRIC,),
    quantile_mode: str = "exact",
    small_group: int | None = None,
) -> DataFrame:
    """One profile row per metric; metrics without a non-zero value are absent.

    ``data`` is a wide ``MetricFrame`` or a long table with ``keys`` and ``value``.
    ``quantile_mode`` "approx" replaces the percentiles by a sketch, one pass in all.
    """
    if quantile_mode not in ("exact", "approx"):
        raise ValueError(f"unknown quantile mode: {quantile_mode}")
    keys = list(keys)
    long = data.long() if isinstance(data, MetricFrame) else data
    long = present(long, VALUE).select(*keys, VALUE, non_zero(F.col(VALUE)).alias("x"))
    moments = _moments(F.col("x"), F.col(VALUE))
    if quantile_mode == "approx":
        q = F.percentile_approx("x", list(PROBS), F.lit(Q.ACCURACY)).alias("q")
        stats = long.groupBy(*keys).agg(*moments, q)
    else:
        if isinstance(data, MetricFrame) and len(data.metrics) <= WIDE_LIMIT:
            stats = _wide_moments(data).persist()
        else:
            stats = long.groupBy(*keys).agg(*moments).persist()
        stats = join_keys(stats, Q.percentiles(long, keys, "x", PROBS, stats, small_group), keys)
    others = [k for k in keys if k != METRIC]
    return _fields(stats.where(F.col("n") > 0), others)


def _moments(x: Column, value: Column) -> list[Column]:
    values = (
        F.count("*"), F.count(value), F.count(x), F.avg(x), F.stddev_samp(x),
        F.skewness(x), F.kurtosis(x), F.min(x), F.max(x),
    )
    return [v.alias(name) for v, name in zip(values, MOMENTS)]


def _wide_moments(frame: MetricFrame) -> DataFrame:
    """The moments of a few metrics straight from their columns, without going long."""
    aggregates, lines = [], []
    for i, name in enumerate(frame.metrics):
        value = quoted(name)
        moments = _moments(non_zero(value), value)
        aggregates += [m.alias(f"m{i}_{j}") for j, m in enumerate(moments)]
        fields = [F.col(f"m{i}_{j}").alias(field) for j, field in enumerate(MOMENTS)]
        lines.append(F.struct(F.lit(name).alias(METRIC), *fields))
    return frame.df.agg(*aggregates).select(F.inline(F.array(*lines)))


def _fields(stats: DataFrame, others: list[str]) -> DataFrame:
    n, total, rows = F.col("n"), F.col("total_records"), F.col("all_rows")
    p05, p25, p50, p75, p95 = (F.get("q", F.lit(i)) for i in range(len(PROBS)))
    derived = {
        "median": p50,
        "skewness": sample_skewness(F.col("g1"), n),
        "kurtosis": sample_kurtosis(F.col("g2"), n),
        "p05": p05,
        "p25": p25,
        "p75": p75,
        "p95": p95,
        "iqr": p75 - p25,
        "null_count": rows - total,
        "null_percentage": percentage(rows - total, rows),
        "non_zero_records": n,
        "zero_count": total - n,
        "zero_percentage": percentage(total - n, total),
    }
    columns = [derived.get(f, F.col(f)).alias(f) for f in PROFILE_FIELDS]
    return stats.select(*others, *columns)


def metric_profile(frame: MetricFrame, name: str) -> DataFrame | None:
    """Profile of one metric; None for an unknown name."""
    if name not in frame.metrics:
        return None
    return profile(frame.only([name]))


def overview(frame: MetricFrame) -> DataFrame:
    """One row: metrics, rows, first and last time, whole days between them."""
    ts = quoted(frame.ts)
    row = frame.df.agg(
        F.count("*").alias("total_timestamps"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )
    return row.select(
        F.lit(len(frame.metrics)).alias("total_metrics"),
        "total_timestamps",
        F.struct("start", "end").alias("data_range"),
        F.expr("timestampdiff(DAY, start, end)").alias("time_span_days"),
    )


def overview_long(long: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Overview of a long table, one row per ``keys``."""
    per_metric = long.groupBy(*keys, METRIC).agg(
        F.count("*").alias("rows"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )
    row = per_metric.groupBy(*keys).agg(
        F.count("*").cast("int").alias("total_metrics"),
        F.max("rows").alias("total_timestamps"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
    )
    return row.select(
        *keys,
        "total_metrics",
        "total_timestamps",
        F.struct("start", "end").alias("data_range"),
        F.expr("timestampdiff(DAY, start, end)").alias("time_span_days"),
    )


def summary(profiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many profiles there are, how many have zeros, mean zero and null share."""
    return profiles.groupBy(*keys).agg(
        F.count("*").alias("total_metrics_analyzed"),
        F.count_if(F.col("zero_count") > 0).alias("metrics_with_zeros"),
        F.avg("zero_percentage").alias("avg_zero_percentage"),
        F.avg("null_percentage").alias("avg_null_percentage"),
    )


def top_zero(profiles: DataFrame, n: int = 5) -> DataFrame:
    """The metrics with the largest zero share."""
    return (
        profiles.orderBy(F.desc_nulls_last("zero_percentage"), METRIC)
        .limit(n)
        .select(METRIC, "zero_percentage", "zero_count", "total_records")
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    counts = []
    for i, name in enumerate(names):
        missing = quoted(name).isNull()
        if kinds[name] in ("double", "float"):
            missing = missing | F.isnan(quoted(name))
        counts.append(F.count_if(missing).alias(f"c{i}"))
    row = df.agg(*counts)
    pairs = [F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("missing")) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*pairs)))


def describe(
    df: DataFrame, features: Sequence[str], small_group: int | None = None
) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per feature."""
    long = df.unpivot([], [nan_to_double(f) for f in features], "feature", VALUE)
    stats = long.groupBy("feature").agg(
        F.count(VALUE).alias("n"),
        F.avg(VALUE).alias("mean"),
        F.stddev_samp(VALUE).alias("std"),
        F.min(VALUE).alias("min"),
        F.max(VALUE).alias("max"),
    ).persist()
    points = Q.percentiles(long, ["feature"], VALUE, (0.25, 0.5, 0.75), stats, small_group)
    quartiles = [F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return stats.join(points, "feature", "left").select(
        "feature", "n", "mean", "std", "min", *quartiles, "max"
    )


def nan_to_double(name: str) -> Column:
    """A feature column as double under its own name, NaN as NULL."""
    return F.nanvl(quoted(name).cast("double"), F.lit(None).cast("double")).alias(name)
