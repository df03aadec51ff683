"""Pearson correlation on non-zero values, pairwise complete, from mergeable co-moments.

The state of a pair of metrics is the number of its common rows, both means on them, both sums of
squared deviations and the sum of products of deviations. States of disjoint rows merge exactly, so
a task folds its batches, and the tasks' states fold in one shuffle; no second scan is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gaugework.functions.scalars import non_zero, quoted
from gaugework.session import stored
from gaugework.sources.metrics import MetricFrame

CELLS = 1 << 21  # pairs whose states a task holds
BLOCK = 64  # metrics on either side of the blocks that tasks hand over
GROUP = 32  # states of a block that are merged at once
STEADY = 1e-6  # share of a batch's squares below which the deviations of a pair are taken row by row
STATE = 6  # rows, mean and mean, squares and squares, products


def correlation(frame: MetricFrame) -> DataFrame:
    """``metric_a, metric_b, corr`` for every ordered pair, diagonal included.

    A pair without variation on its common rows has a NULL correlation. Values that vary little
    around a large mean keep their digits: deviations are taken from means within a batch, and
    states merge by the differences of their means.
    """
    names = list(frame.metrics)
    masked = frame.df.select(*[non_zero(quoted(m)).cast("double").alias(f"m{i}") for i, m in enumerate(names)])
    half = _coefficients(_merged(_partial_states(masked, len(names))), len(names))
    label = F.array(*[F.lit(n) for n in names])
    half = half.select(F.get(label, "a").alias("metric_a"), F.get(label, "b").alias("metric_b"), "corr")
    both = F.array(F.struct("metric_a", "metric_b", "corr"), F.struct(F.col("metric_b").alias("metric_a"), F.col("metric_a").alias("metric_b"), "corr"))
    sides = F.when(F.col("metric_a") == F.col("metric_b"), F.slice(both, 1, 1)).otherwise(both)
    return half.select(F.inline(sides))


def correlation_wide(frame: MetricFrame) -> DataFrame:
    """The matrix with one row per metric and one column per metric."""
    wide = correlation(frame).groupBy("metric_a").pivot("metric_b", list(frame.metrics)).agg(F.first("corr"))
    return wide.withColumnRenamed("metric_a", "metric_name")


def batch_state(x: np.ndarray, height: int) -> np.ndarray:
    """The states of the first ``height`` columns with all columns of a batch; NaN is missing."""
    present = ~np.isnan(x)
    counts = present.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        low, high = np.where(present, x, np.inf).min(axis=0, initial=np.inf), np.where(present, x, -np.inf).max(axis=0, initial=-np.inf)
        centre = np.where(counts > 0, np.where(low == high, low, np.where(present, x, 0.0).sum(axis=0) / np.maximum(counts, 1)), 0.0)
    d = np.where(present, x - centre, 0.0)
    p = present.astype(float)
    own, own_p = d[:, :height].T, p[:, :height].T
    square = d * d
    n = own_p @ p
    some = np.maximum(n, 1.0)
    sa, sb = own @ p, own_p @ d
    raw_a, raw_b = square[:, :height].T @ p, own_p @ square
    state = np.stack([n, centre[:height, None] + sa / some, centre[None, :] + sb / some, raw_a - sa * sa / some, raw_b - sb * sb / some, own @ d - sa * sb / some])
    state[3:, n <= 1] = 0.0
    doubtful = (n > 1) & ((state[3] < STEADY * raw_a) | (state[4] < STEADY * raw_b))
    at_a, at_b = np.nonzero(doubtful)
    for lo in range(0, len(at_a), 256):
        a, b = at_a[lo : lo + 256], at_b[lo : lo + 256]
        common = present[:, a] & present[:, b]
        first = common.argmax(axis=0), np.arange(len(a))
        # from a value of the common rows: equal values deviate by nothing at all
        base_a, base_b = x[:, a][first], x[:, b][first]
        u, v = np.where(common, x[:, a] - base_a, 0.0), np.where(common, x[:, b] - base_b, 0.0)
        m = n[a, b]
        mean_u, mean_v = u.sum(axis=0) / m, v.sum(axis=0) / m
        u, v = np.where(common, u - mean_u, 0.0), np.where(common, v - mean_v, 0.0)
        state[1:, a, b] = base_a + mean_u, base_b + mean_v, (u * u).sum(axis=0), (v * v).sum(axis=0), (u * v).sum(axis=0)
    return state


def merge_states(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The state of the rows of both."""
    n = one[0] + two[0]
    share = np.divide(two[0], n, out=np.zeros_like(n), where=n > 0)
    empty = one[0] == 0
    da, db = np.where(empty | (two[0] == 0), 0.0, two[1] - one[1]), np.where(empty | (two[0] == 0), 0.0, two[2] - one[2])
    weight = one[0] * share
    return np.stack(
        [
            n,
            np.where(empty, two[1], one[1] + da * share),
            np.where(empty, two[2], one[2] + db * share),
            one[3] + two[3] + da * da * weight,
            one[4] + two[4] + db * db * weight,
            one[5] + two[5] + da * db * weight,
        ]
    )


SCHEMA = "i int, j int, part int, state binary"


def _partial_states(masked: DataFrame, size: int) -> DataFrame:
    """Every task's states in blocks of metrics; tables too wide for one scan are read in bands."""
    names = masked.columns

    def band(lo: int, hi: int):
        def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((STATE, hi - lo, size - lo))
            for batch in batches:
                if len(batch):
                    total = merge_states(total, batch_state(batch.to_numpy(dtype=float), hi - lo))
            part = TaskContext.get().partitionId()
            for i in range(0, hi - lo, BLOCK):
                blocks = [(j, total[:, i : i + BLOCK, j : j + BLOCK]) for j in range(i, size - lo, BLOCK)]
                kept = [(j, np.ascontiguousarray(b).tobytes()) for j, b in blocks if b[0].any()]
                yield pd.DataFrame({"i": [i + lo] * len(kept), "j": [j + lo for j, _ in kept], "part": [part] * len(kept), "state": [b for _, b in kept]})

        return masked.select(*names[lo:]).mapInPandas(states, SCHEMA)

    height = max(1, CELLS // size)
    height = height if height >= size else max(height // BLOCK, 1) * BLOCK
    whole = None
    for lo in range(0, size, height):
        part = band(lo, min(lo + height, size))
        whole = part if whole is None else whole.union(part)
    return whole


def _merged(states: DataFrame) -> DataFrame:
    """One state per block: groups of tasks first, so that no group is large."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in rows["state"]:
            state = np.frombuffer(blob).reshape(STATE, -1)
            total = state if total is None else merge_states(total, state)
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "part": [key[2]], "state": [total.tobytes()]})

    parts = states.rdd.getNumPartitions()
    for _ in range(max(math.ceil(math.log(max(parts, 2), GROUP)), 1)):
        states = states.withColumn("part", F.expr(f"part div {GROUP}").cast("int"))
        states = states.groupBy("i", "j", "part").applyInPandas(fold, SCHEMA)
    return stored(states)


def _coefficients(states: DataFrame, size: int) -> DataFrame:
    """``a, b, corr`` with a <= b; pairs that no row has in common are NULL as well."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, blob in zip(batch["i"], batch["j"], batch["state"]):
                wide = min(BLOCK, size - j)
                state = np.frombuffer(blob).reshape(STATE, -1, wide)
                a, b = np.meshgrid(np.arange(i, i + state.shape[1]), np.arange(j, j + wide), indexing="ij")
                n, _, _, va, vb, ab = state
                good = (n > 1) & (va > 0) & (vb > 0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    corr = np.where(good, np.clip(ab / np.sqrt(va) / np.sqrt(vb), -1.0, 1.0), np.nan)
                keep = a <= b
                yield pd.DataFrame({"a": a[keep], "b": b[keep], "value": corr[keep]})

    found = states.mapInPandas(rows, "a int, b int, value double").withColumn("corr", F.nanvl("value", F.lit(None).cast("double"))).drop("value")
    places = states.sparkSession.range(size).select(F.col("id").cast("int").alias("a"))
    pairs = places.select("a", F.explode(F.sequence("a", F.lit(size - 1))).alias("b"))
    return pairs.join(found, ["a", "b"], "left")
