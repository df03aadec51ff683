"""The numbers behind distribution plots: histogram, density, markers, boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugework.functions.scalars import non_zero, present, sample_kurtosis, sample_skewness
from gaugework.operators import quantiles as Q
from gaugework.operators.joins import attach, join_keys
from gaugework.operators.profile import nan_to_double
from gaugework.session import stored
from gaugework.sources.metrics import METRIC, VALUE

BINS = 50
GRID_POINTS = 100
BANDWIDTH = 0.5
GRIDS = 256  # densities that a task adds up at once
SPLIT = 65_536  # values of a metric per share, when values are shuffled


def _values(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    long = present(long, VALUE)
    return long.select(*keys, non_zero(F.col(VALUE)).alias("v")).where(F.col("v").isNotNull())


def histogram(long: DataFrame, keys: Sequence[str] = (METRIC,), bins: int = BINS) -> DataFrame:
    """Density histogram of the non-zero values, equal bins from least to greatest.

    All bins appear, empty ones with density 0; the last bin is closed. A constant
    metric gets a range of one around its value.
    """
    keys = list(keys)
    values = _values(long, keys)
    constant = F.col("min") == F.col("max")
    lo = F.when(constant, F.col("min") - 0.5).otherwise(F.col("min"))
    hi = F.when(constant, F.col("max") + 0.5).otherwise(F.col("max"))
    ranges = (
        Q.group_bounds(values, keys, "v")
        .select(*keys, "n", lo.alias("lo"), hi.alias("hi"))
        .withColumn("width", (F.col("hi") - F.col("lo")) / bins)
        .persist()
    )
    counted = (
        attach(values, ranges, keys)
        .select(*keys, _bin(bins).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("n_values"))
    )
    spine = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    left = F.col("lo") + F.col("bin") * F.col("width")
    n_values = F.coalesce("n_values", F.lit(0).cast("bigint"))
    return join_keys(spine, counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        left.alias("bin_left"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_right"),
        n_values.alias("n_values"),
        (n_values / (F.col("n") * F.col("width"))).alias("density"),
    )


def _bin(bins: int):
    """Bin by division, then corrected against the bin edges."""
    v, lo, width = F.col("v"), F.col("lo"), F.col("width")
    guess = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    too_high = v < lo + guess * width
    too_low = (v >= lo + (guess + 1) * width) & (guess < bins - 1)
    return F.when(too_high, guess - 1).when(too_low, guess + 1).otherwise(guess)


def kde(
    long: DataFrame,
    keys: Sequence[str] = (METRIC,),
    points: int = GRID_POINTS,
    bandwidth: float = BANDWIDTH,
) -> DataFrame:
    """Gaussian kernel density of the non-zero values at evenly spaced points.

    The kernel width is ``bandwidth`` times the sample deviation. Metrics with one value or without
    variation have no density. Up to ``GRIDS`` metrics are added up by every task that meets them, so
    the shuffle holds grids, not values. More metrics would make a grid of nearly every value: their
    values are counted and dealt by metric, those of a large one in shares, and each share gives one grid.
    """
    keys = list(keys)
    values = _values(long, keys)
    v = F.col("v")
    shape = values.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        (F.stddev_samp(v) * bandwidth).alias("h"),
    )
    shape = shape.where((F.col("n") > 1) & (F.col("lo") < F.col("hi")))
    shape = stored(shape.withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1)).withColumn("g", F.monotonically_increasing_id()))
    metrics = shape.count()
    if metrics <= GRIDS:
        weighted = attach(values.withColumn("w", F.lit(1.0)), shape, keys, known_rows=metrics)
    else:
        counted = values.groupBy(*keys, "v").agg(F.count("*").cast("double").alias("w"))
        share = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / SPLIT))
        weighted = attach(counted, shape, keys, known_rows=metrics).repartition("g", share).sortWithinPartitions("g")
    sums = (
        weighted.select("g", "v", "w", "lo", "step", "h")
        .mapInPandas(_grid_sums(points), "g long, kernels array<double>")
        .select("g", F.posexplode("kernels").alias("point", "kernel"))
        .groupBy("g", "point")
        .agg(F.sum("kernel").alias("kernel"))
    )
    scale = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return sums.join(shape, "g").select(
        *keys, "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"), (F.col("kernel") / scale).alias("density")
    )


def _grid_sums(points: int):
    """Batches (g, v, w, lo, step, h) to the kernel sums of each g that the task meets.

    Equal values of a batch are taken once; there is no work per metric but adding its grid.
    """
    place = np.arange(points)

    def lines(held: dict[int, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"g": list(held), "kernels": list(held.values())})

    def starts(*columns: np.ndarray) -> np.ndarray:
        """Where a row differs from the one before."""
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.flatnonzero(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            g, v, w, lo, step, h = (batch[c].to_numpy() for c in ("g", "v", "w", "lo", "step", "h"))
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            first = starts(g, v)
            w = np.add.reduceat(w[order], first)
            g, v = g[first], v[first]
            lo, step, h = (c[order][first] for c in (lo, step, h))
            for a in range(0, len(v), 2048):
                part = slice(a, a + 2048)
                z = (lo[part, None] + place * step[part, None] - v[part, None]) / h[part, None]
                kernels = w[part, None] * np.exp(z * z * -0.5)
                first = starts(g[part])
                for one, grid in zip(g[part][first], np.add.reduceat(kernels, first, axis=0)):
                    if one in held:
                        held[one] += grid
                    else:
                        held[one] = grid.copy()
            if len(held) > GRIDS:
                yield lines(held)
                held = {}
        if held:
            yield lines(held)

    return run


def markers(long: DataFrame, keys: Sequence[str] = (METRIC,)) -> DataFrame:
    """Median and upper quartile of the non-zero values."""
    points = Q.percentiles(_values(long, keys), keys, "v", (0.5, 0.75))
    return points.select(*keys, F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p75"))


def shape_with_zeros(long: DataFrame, keys: Sequence[str] = (METRIC,)) -> DataFrame:
    """Skewness and kurtosis of all present values, zeros included."""
    v = F.col(VALUE)
    n = F.count(v)
    return present(long, VALUE).groupBy(*keys).agg(
        sample_skewness(F.skewness(v), n).alias("skewness"),
        sample_kurtosis(F.kurtosis(v), n).alias("kurtosis"),
    )


def box_stats(
    df: DataFrame, features: Sequence[str], by: str = "cluster", reach: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers and outlying count of each feature per label."""
    long = melt(df, [by], features)
    keys = [by, "feature"]
    rows = long.where(F.col(VALUE).isNotNull())
    q = Q.percentiles(rows, keys, VALUE, (0.25, 0.5, 0.75))
    boxes = q.select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    boxes = boxes.persist()
    spread = (F.col("q3") - F.col("q1")) * reach
    v = F.col(VALUE)
    near = v.between(F.col("q1") - spread, F.col("q3") + spread)
    return (
        attach(rows, boxes, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(near, v)).alias("whisker_low"),
            F.max(F.when(near, v)).alias("whisker_high"),
            F.count_if(~near).alias("n_outside"),
        )
    )


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide to long: the id columns, ``feature`` and ``value``."""
    return df.unpivot(list(ids), [nan_to_double(f) for f in features], "feature", VALUE)
