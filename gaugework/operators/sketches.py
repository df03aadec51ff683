"""Profiles from stored states: moments and quantile sketches that add up over parts of a table.

A state is one row per metric and part (a day, a file): row counts, central moments, extremes and a
KLL sketch of the non-zero values. States of disjoint parts merge, so a profile over any selection
of parts comes from their states, without another look at the readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.scalars import non_zero, present
from gaugework.operators.joins import attach, join_keys
from gaugework.operators.profile import PROBS, _fields
from gaugework.sources.metrics import METRIC, VALUE

SKETCH_SIZE = 2_048
RANK_ERROR = 0.005  # of a quantile of a sketch of that size, with a wide margin

STATE = ("all_rows", "total_records", "n", "mean", "m2", "m3", "m4", "min", "max", "sketch")


def metric_states(long: DataFrame, keys: Sequence[str] = (METRIC,), parts: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """One state per ``keys`` and ``parts`` of a long table: the columns of both and ``STATE``.

    Missing readings count as rows only. One scan, one shuffle of states.
    """
    long = present(long, VALUE).select(*keys, *parts, VALUE, non_zero(F.col(VALUE)).cast("double").alias("x"))
    x, n = F.col("x"), F.count("x")
    m2 = F.var_pop(x) * n
    states = long.groupBy(*keys, *parts).agg(
        F.count("*").alias("all_rows"),
        F.count(VALUE).alias("total_records"),
        n.alias("n"),
        F.avg(x).alias("mean"),
        m2.alias("m2"),
        (F.skewness(x) * F.pow(F.var_pop(x), F.lit(1.5)) * n).alias("m3"),
        ((F.kurtosis(x) + 3) * F.var_pop(x) * m2).alias("m4"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"),
    )
    zero = F.lit(0.0)
    return states.withColumns({c: F.when(F.col("n") > 0, F.coalesce(F.col(c), zero)) for c in ("m2", "m3", "m4")})


def merged_states(states: DataFrame, keys: Sequence[str] = (METRIC,), size: int = SKETCH_SIZE) -> DataFrame:
    """The states of all parts of ``keys`` as one; merged states merge again."""
    keys = list(keys)
    n = F.col("n").cast("double")
    means = states.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("whole"))
    rows = join_keys(states, means, keys).withColumn("d", F.coalesce(F.col("mean") - F.col("whole"), F.lit(0.0)))
    d = F.col("d")
    m2, m3, m4 = (F.coalesce(c, F.lit(0.0)) for c in ("m2", "m3", "m4"))
    return rows.groupBy(*keys).agg(
        F.sum("all_rows").alias("all_rows"),
        F.sum("total_records").alias("total_records"),
        F.sum("n").alias("n"),
        F.first("whole").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
    )


def profile_of_states(states: DataFrame, keys: Sequence[str] = (METRIC,)) -> DataFrame:
    """The profile rows of states, one per ``keys``; percentiles within ``RANK_ERROR`` of their rank."""
    n, m2 = F.col("n").cast("double"), F.col("m2")
    varies = (m2 > 0) & (F.col("min") < F.col("max"))
    stats = states.where("n > 0").withColumns(
        {
            "std_dev": F.when(F.col("n") > 1, F.when(varies, F.sqrt(m2 / (n - 1))).otherwise(0.0)),
            "g1": F.when(varies, F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5))),
            "g2": F.when(varies, n * F.col("m4") / (m2 * m2) - 3),
            "q": F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in PROBS]),
        }
    )
    return _fields(stats, [k for k in keys if k != METRIC])


def rank_errors(long: DataFrame, profiles: DataFrame, keys: Sequence[str] = (METRIC,), fields: Sequence[str] = ("p05", "p25", "median", "p75", "p95")) -> DataFrame:
    """Per metric how far, as a share of its values, each percentile lies from its rank.

    The values of a metric stay where they are read, unless there are too many metrics to broadcast.
    """
    keys = list(keys)
    values = present(long, VALUE).select(*keys, non_zero(F.col(VALUE)).alias("x")).where("x IS NOT NULL")
    both = attach(values, profiles.select(*keys, *fields), keys)

    def error(field: str, rank: float) -> Column:
        below, upto = F.count_if(F.col("x") < F.col(field)), F.count_if(F.col("x") <= F.col(field))
        wanted = F.lit(rank) * F.count("*")
        return (F.greatest(below - wanted, wanted - upto, F.lit(0.0)) / F.count("*")).alias(field)

    return both.groupBy(*keys).agg(*[error(f, p) for f, p in zip(fields, PROBS)])
