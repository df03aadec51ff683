"""Outlier flags on prepared features."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gaugework.functions.scalars import quoted
from gaugework.operators import quantiles as Q
from gaugework.operators.dbscan import noise_flags

METHODS = ("isolation_forest", "zscore", "dbscan")
TREES = 100
SAMPLE = 256
EULER_GAMMA = 0.5772156649015329


def flag_outliers(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    method: str | None,
    fraction: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """``df`` plus ``is_outlier``; ``method`` None flags nothing."""
    if method is None:
        return df.withColumn("is_outlier", F.lit(False))
    if method == "zscore":
        return zscore_flags(df, columns)
    if method == "isolation_forest":
        return isolation_forest_flags(df, key, columns, fraction, seed)
    if method == "dbscan":
        return noise_flags(df, key, columns)
    raise ValueError(f"unknown outlier method: {method}")


def zscore_flags(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Rows with any feature more than ``limit`` population deviations off its mean."""
    stats = df.agg(
        *[F.avg(quoted(c)) for c in columns], *[F.stddev_pop(quoted(c)) for c in columns]
    ).first()
    size = len(columns)
    tests = []
    for i, c in enumerate(columns):
        mean, spread = stats[i], stats[size + i]
        if spread:
            tests.append(F.abs((quoted(c) - F.lit(mean)) / F.lit(spread)) > limit)
    far = functools.reduce(lambda a, b: a | b, tests, F.lit(False))
    return df.withColumn("is_outlier", F.coalesce(far, F.lit(False)))


def split_outliers(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Main rows and outlying rows."""
    return flagged.where(~F.col("is_outlier")), flagged.where("is_outlier")


# -- isolation forest ----------------------------------------------------------

ROW = "_row"  # what tells a row from others while it is drawn
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


def isolation_forest_flags(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    fraction: float = 0.1,
    seed: int = 42,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Flag the ``fraction`` of rows that random trees isolate soonest."""
    scored = isolation_scores(df, key, columns, seed, trees, sample).persist()
    cut = Q.percentiles(
        scored.select(F.lit(0).alias("all_rows"), "normality"), ["all_rows"], "normality", (fraction,)
    ).first()
    if cut is None:
        return scored.drop("normality").withColumn("is_outlier", F.lit(False))
    return scored.withColumn("is_outlier", F.col("normality") < cut["q"][0]).drop("normality")


def isolation_scores(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    seed: int = 42,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """``df`` plus ``normality``, in -1..0; the lowest rows are the easiest to isolate.

    Each tree grows from its own hash sample of the rows. The forest has at most
    ``trees * 2 * sample`` nodes whatever the size of the table, so it is sent to
    the tasks and every row is scored where it lies.
    """
    n = df.count()
    size = min(sample, n)
    drawn = _tree_samples(df, key, columns, n, size, trees, seed)
    features = [f"x{i}" for i in range(len(columns))]
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        group = group.sort_values(["draw", *features])
        nodes = _grow_tree(group[features].to_numpy(float), limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *node) for node in nodes], columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    forest = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    tables = [
        t.sort_values("node")[["feature", "threshold", "left", "right", "length"]].to_numpy(float)
        for _, t in forest.groupby("tree")
    ]
    usual = _average_path(size)

    @F.pandas_udf("double")
    def normality(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([s.to_numpy(float) for s in batch])
            depth = sum(_path_lengths(x, table) for table in tables)
            yield pd.Series(-np.power(2.0, -depth / (len(tables) * usual)))

    return df.withColumn("normality", normality(*[quoted(c) for c in columns]))


def _tree_samples(df, key, columns, n, size, trees, seed):
    """``size`` rows per tree without replacement, by a hash of row and tree.

    A row is told by its key and values, which makes the draw independent of the layout of the
    table. Where rows repeat in full they are told by their place instead, so that each of them is
    drawn for itself and keys play no part.

    Rows are thinned by the hash before they are copied to a tree, so the shuffle
    carries about ``2 * size`` rows per tree, not ``trees`` copies of the table.
    """
    space = 1 << 30
    keep = space if n <= 2 * size else min(space, int(space * 2.0 * size / n) + 1)
    told = F.xxhash64(quoted(key), *[quoted(c) for c in columns])
    if not df.groupBy(told.alias("row")).count().where("count > 1").isEmpty():
        told = F.monotonically_increasing_id()
    df = df.withColumn(ROW, told)
    draw = lambda tree: F.pmod(F.xxhash64(F.col(ROW), tree, F.lit(seed)), F.lit(space))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < keep)
    points = [quoted(c).alias(f"x{i}") for i, c in enumerate(columns)]
    copies = df.select(ROW, *points, F.explode(chosen).alias("tree"))
    ranked = copies.withColumn("draw", F.pmod(F.xxhash64(ROW, "tree", F.lit(seed)), F.lit(space)))
    order = Window.partitionBy("tree").orderBy("draw", ROW)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).drop(ROW, "rank")


def _average_path(n) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    usual = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, usual))


def _grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes ``(id, feature, threshold, left, right, length)`` of one random tree.

    ``length`` is the path length credited at a leaf; ``feature`` -1 marks leaves.
    """
    nodes: list[tuple] = [()]
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        node, rows, depth = waiting.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes[node] = (node, -1, 0.0, -1, -1, float(depth + _average_path(len(rows))))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[node] = (node, feature, threshold, left, right, 0.0)
        waiting += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def _path_lengths(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    feature = table[:, 0].astype(int)
    left, right = table[:, 2].astype(int), table[:, 3].astype(int)
    at = np.zeros(len(x), dtype=int)
    rows = np.arange(len(x))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return table[at, 4]
        f = np.where(inner, feature[at], 0)
        step = np.where(x[rows, f] <= table[at, 1], left[at], right[at])
        at = np.where(inner, step, at)
