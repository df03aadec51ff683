"""Feature preparation: median imputation, scaling, weights.

Fitting reads a few numbers per feature to the driver; applying is a projection
with those numbers as literals, so the prepared columns stay beside the raw ones
and no join is needed.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.scalars import quoted
from gaugework.operators import quantiles as Q
from gaugework.operators.profile import nan_to_double
from gaugework.sources.metrics import VALUE

METHODS = ("standard", "robust", "minmax")
PREFIX = "prepared_"

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Scale:
    """``(value or fill - center) / spread * weight`` of one feature."""

    feature: str
    fill: float
    center: float
    spread: float
    weight: float

    def expression(self) -> Column:
        filled = F.coalesce(nan_to_double(self.feature), F.lit(self.fill))
        return (filled - F.lit(self.center)) / F.lit(self.spread) * F.lit(self.weight)


@dataclass(frozen=True)
class Preparation:
    key: str
    scales: tuple[Scale, ...]

    @property
    def features(self) -> list[str]:
        return [s.feature for s in self.scales]

    @property
    def prepared(self) -> list[str]:
        """Names of the prepared columns ``beside`` adds."""
        return [PREFIX + s.feature for s in self.scales]

    def beside(self, df: DataFrame) -> DataFrame:
        """The table with its prepared features as further columns."""
        return df.select("*", *[s.expression().alias(PREFIX + s.feature) for s in self.scales])

    def only(self, df: DataFrame) -> DataFrame:
        """Key and prepared features under the feature names."""
        return df.select(quoted(self.key), *[s.expression().alias(s.feature) for s in self.scales])


def split(df: DataFrame, key_col: str | None = None, features: Sequence[str] | None = None):
    """Key and feature names: first column and the rest, unless named."""
    key = key_col or df.columns[0]
    return key, list(features) if features is not None else [c for c in df.columns if c != key]


def column_percentiles(
    df: DataFrame, features: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float]]:
    """Exact percentiles per feature column, read to the driver."""
    long = df.unpivot([], [nan_to_double(f) for f in features], "feature", VALUE)
    return {r["feature"]: list(r["q"]) for r in Q.percentiles(long, ["feature"], VALUE, probs).collect()}


def impute_median(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Key and features, missing cells replaced by the exact median of their column."""
    fills = _fills(df, features)
    return df.select(
        quoted(key), *[F.coalesce(nan_to_double(f), F.lit(fills[f])).alias(f) for f in features]
    )


def _fills(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median per feature; features without gaps need no median pass."""
    gaps = df.agg(*[F.count_if(nan_to_double(f).isNull()).alias(f"c{i}") for i, f in enumerate(features)]).first()
    with_gaps = [f for f, n in zip(features, gaps) if n]
    medians = column_percentiles(df, with_gaps, (0.5,)) if with_gaps else {}
    empty = [f for f in with_gaps if f not in medians]
    if empty:
        log.warning("features without any value are filled with 0: %s", empty)
    return {f: medians.get(f, [0.0])[0] for f in features}


def weight_list(features: Sequence[str], weights: Mapping[str, float] | Sequence[float] | None) -> list[float]:
    """One weight per feature. Features a mapping does not name keep weight 1."""
    if not weights:
        return [1.0] * len(features)
    if isinstance(weights, Mapping):
        unknown = [w for w in weights if w not in features]
        if unknown:
            log.warning("weights of unknown features are ignored: %s", unknown)
        return [float(weights.get(f, 1.0)) for f in features]
    if len(weights) != len(features):
        raise ValueError(f"{len(weights)} weights for {len(features)} features")
    return [float(w) for w in weights]


def fit_preparation(
    df: DataFrame,
    key_col: str | None = None,
    features: Sequence[str] | None = None,
    method: str = "standard",
    weights: Mapping[str, float] | Sequence[float] | None = None,
) -> Preparation:
    """Learn fills, centres and spreads of every feature.

    A feature without variation is scaled to 0 by every method.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalization method: {method}")
    key, names = split(df, key_col, features)
    weight = weight_list(names, weights)
    fills = _fills(df, names)
    filled = df.select(*[F.coalesce(nan_to_double(f), F.lit(fills[f])).alias(f) for f in names])
    pairs = _robust(filled, names) if method == "robust" else _moments(filled, names, method)
    scales = [Scale(f, fills[f], *pairs[f], w) for f, w in zip(names, weight)]
    return Preparation(key, tuple(scales))


def _robust(filled: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    q = column_percentiles(filled, names, (0.25, 0.5, 0.75))
    return {f: (mid, (high - low) or 1.0) for f, (low, mid, high) in q.items()}


def _moments(filled: DataFrame, names: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    center, spread = [], []
    for f in names:
        c = quoted(f)
        center.append(F.avg(c) if method == "standard" else F.min(c))
        spread.append(F.stddev_pop(c) if method == "standard" else F.max(c) - F.min(c))
    row = filled.agg(*center, *spread).first()
    found = {}
    for i, f in enumerate(names):
        found[f] = (row[i], row[len(names) + i] or 1.0)
    return found
