"""k-means with many starts and many k in shared passes, and the choice of k.

Starts are drawn from and first settled on a bounded sample, one task per start.
From there every pass reads all rows, assigns each to the nearest centre of all
models still moving and adds up the new centres map-side, so ten starts of nine
sizes cost as many scans as the slowest single fit. Starts that settled on the
same centres are one model. The rows are packed once into blocks of numbers that
the tasks keep, so that a pass is one short stage and plans nothing.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, Row, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gaugework.functions.scalars import quoted

STARTS = 10
MAX_PASSES = 300
TOLERANCE = 1e-4
SEED_ROWS = 16_384
BLOCK = 1_024  # rows whose distances to all centres are held at once
TASK_BLOCKS = 16  # blocks below which a task of a pass costs more to start than to run
TASK_VALUES = 1 << 22  # numbers that a task of a pass reads
DRIVER_VALUES = 1 << 21  # sums of a pass that the driver adds up without a step between


@dataclass(frozen=True)
class Model:
    """Centres of one fit and the sums of the rows assigned to them.

    ``norms`` adds up squared row lengths per cluster, ``means`` are the averages of
    the assigned rows, ``cost`` is the within-cluster sum of squares.
    """

    centers: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    norms: np.ndarray
    cost: float

    @property
    def k(self) -> int:
        return len(self.centers)


def fit(
    df: DataFrame, key: str, columns: Sequence[str], k: int, starts: int = STARTS, seed: int = 42
) -> Model:
    """The cheapest of ``starts`` fits."""
    return fit_many(df, key, columns, [k], starts, seed)[0]


def fit_many(
    df: DataFrame, key: str, columns: Sequence[str], ks: Sequence[int], starts: int = STARTS, seed: int = 42
) -> list[Model]:
    """The cheapest fit for every k, all fitted side by side."""
    points = df.select(quoted(key).alias("row_key"), *[quoted(c).alias(f"x{i}") for i, c in enumerate(columns)]).persist()
    stats = points.agg(F.count("*"), *[F.var_pop(f"x{i}") for i in range(len(columns))]).first()
    rows, variances = stats[0], [v or 0.0 for v in stats[1:]]
    if max(ks) > rows:
        raise ValueError(f"{max(ks)} clusters need at least as many rows, found {rows}")
    tolerance = TOLERANCE * float(np.mean(variances))
    seeds = _seed_points(points, len(columns), rows, seed)
    slots = [(k, s) for k in ks for s in range(starts)]
    centers = _starts(df.sparkSession, seeds, slots, seed)
    models: list[Model | None] = [None] * len(slots)
    moving = _different(slots, centers)
    blocks = _dealt(points, len(columns), rows)
    for step in range(MAX_PASSES + 1):
        totals = _pass(blocks, len(columns), [centers[m] for m in moving])
        still = []
        for m, (sizes, sums, norms, cost) in zip(moving, totals):
            filled = sizes > 0
            moved = centers[m].copy()
            moved[filled] = sums[filled] / sizes[filled, None]
            models[m] = Model(centers[m], sizes, moved, norms, cost)
            if ((moved - centers[m]) ** 2).sum() > tolerance and step < MAX_PASSES:
                centers[m] = moved
                still.append(m)
        moving = still
        if not moving:
            break
    blocks.unpersist()
    points.unpersist()
    best = {}
    for (k, _), model in zip(slots, models):
        if model is not None and (k not in best or model.cost < best[k].cost):
            best[k] = model
    return [best[k] for k in ks]


def _different(slots: Sequence[tuple[int, int]], centers: list[np.ndarray]) -> list[int]:
    """The first slot of each set of centres, in any order: starts that settled on the same ones go one way."""
    seen, first = set(), []
    for i, ((k, _), own) in enumerate(zip(slots, centers)):
        digits = np.round(own / (np.abs(own).max() or 1.0), 9) + 0.0
        mark = (k, digits[np.lexsort(digits.T)].tobytes())
        if mark not in seen:
            seen.add(mark)
            first.append(i)
    return first


def from_centers(df: DataFrame, columns: Sequence[str], centers: np.ndarray) -> Model:
    """The model of given centres: every row goes to the nearest one, and one scan adds the rows up."""
    centers = np.asarray(centers, float)
    points = df.select(*[quoted(c).alias(f"x{i}") for i, c in enumerate(columns)])
    (sizes, sums, norms, cost), *_ = _pass(_packed(points, len(columns)).rdd, len(columns), [centers])
    means = np.divide(sums, sizes[:, None], out=centers.copy(), where=sizes[:, None] > 0)
    return Model(centers, sizes, means, norms, cost)


def _seed_points(points: DataFrame, size: int, rows: int, seed: int) -> np.ndarray:
    """A hash sample of at most ``SEED_ROWS`` rows to place the first centres.

    Only starting points come from it; every pass of the fit reads all rows.
    """
    space = 1 << 30
    draw = F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(space))
    keep = space if rows <= 2 * SEED_ROWS else int(space * 2.0 * SEED_ROWS / rows) + 1
    names = [f"x{i}" for i in range(size)]
    chosen = points.where(draw < keep).orderBy(draw, "row_key").limit(SEED_ROWS)
    return chosen.select(*names).toPandas().to_numpy(float)


def _starts(
    spark: SparkSession, seeds: np.ndarray, slots: Sequence[tuple[int, int]], seed: int
) -> list[np.ndarray]:
    """Centres per slot, settled on the seed rows; the slots are spread over the tasks."""

    tasks = min(len(slots), spark.sparkContext.defaultParallelism)
    dealt = [i for task in range(tasks) for i in range(task, len(slots), tasks)]  # small and large k to every task

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [dealt[i] for i in batch["id"]]
            found = []
            for k, start in (slots[i] for i in own):
                centers = _spread_seeds(seeds, k, np.random.default_rng([seed, k, start]))
                found.append(_at_rest(seeds, centers).ravel())
            yield pd.DataFrame({"id": own, "centers": found})

    rows = spark.range(0, len(slots), 1, tasks).mapInPandas(settle, "id long, centers array<double>").collect()
    settled = {r["id"]: np.array(r["centers"]).reshape(slots[r["id"]][0], -1) for r in rows}
    return [settled[i] for i in range(len(slots))]


def _at_rest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centres once no row changes its cluster; sums follow the rows that do."""
    rows = np.column_stack([np.ones(len(points)), points])
    across = np.ascontiguousarray(points.T)
    label, sums = None, np.zeros((len(centers), rows.shape[1]))
    for _ in range(MAX_PASSES):
        distance = (centers * centers).sum(axis=1)[:, None] - 2.0 * (centers @ across)  # less the row's own square
        before, label, least = label, np.zeros(len(points), np.intp), distance[0]
        for i in range(1, len(centers)):
            label[distance[i] < least] = i
            np.minimum(least, distance[i], out=least)
        changed = np.arange(len(points)) if before is None else np.flatnonzero(label != before)
        if not len(changed):
            break
        step = np.zeros((len(centers), len(changed)))
        step[label[changed], np.arange(len(changed))] = 1.0
        if before is not None:
            step[before[changed], np.arange(len(changed))] = -1.0
        sums += step @ rows[changed]
        sizes = sums[:, :1]
        centers = np.divide(sums[:, 1:], sizes, out=centers.copy(), where=sizes > 0)
    return centers


def _spread_seeds(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres by squared-distance draws (k-means++)."""
    centers = [points[rng.integers(len(points))]]
    nearest = ((points - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k:
        total = nearest.sum()
        pick = rng.choice(len(points), p=nearest / total) if total > 0 else rng.integers(len(points))
        centers.append(points[pick])
        nearest = np.minimum(nearest, ((points - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centre."""
    square = (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)
    return np.maximum(square - 2.0 * x @ centers.T, 0.0)


def _packed(points: DataFrame, size: int) -> DataFrame:
    """The rows as blocks of numbers, which passes read without taking columns apart."""
    names = [f"x{i}" for i in range(size)]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[names].to_numpy(float)
            yield pd.DataFrame({"block": [rows[a : a + BLOCK].tobytes() for a in range(0, len(rows), BLOCK)]})

    return points.select(*names).mapInPandas(pack, "block binary")


def _dealt(points: DataFrame, size: int, rows: int) -> RDD[Row]:
    """The packed rows, kept by as many tasks as there are cores, fewer for few rows and more for many."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(rows * size / TASK_VALUES), min(cores, math.ceil(rows / (TASK_BLOCKS * BLOCK))))
    return _packed(points, size).repartition(tasks).rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _pass(blocks: RDD[Row], size: int, models: list[np.ndarray]):
    """Per model: cluster sizes, coordinate sums, summed squared norms, total cost."""
    bounds = np.cumsum([0] + [len(m) for m in models])
    parts = list(zip(bounds[:-1], bounds[1:]))
    stacked = np.vstack(models)
    none = np.zeros((len(stacked), size + 3))

    def add(total: np.ndarray, row: Row) -> np.ndarray:
        return total + _sums(np.frombuffer(row[0]).reshape(-1, size), stacked, parts)

    depth = 1 if none.size * blocks.getNumPartitions() <= DRIVER_VALUES else 2
    found = blocks.treeAggregate(none, add, operator.add, depth)
    for lo, hi in parts:
        part = found[lo:hi]
        yield part[:, 0], part[:, 3:], part[:, 1], float(part[:, 2].sum())


def _sums(x: np.ndarray, stacked: np.ndarray, parts: Sequence[tuple[int, int]]) -> np.ndarray:
    """Per centre: rows nearest to it, their squared norms, their cost (with a model's first centre) and coordinates."""
    square = (x * x).sum(axis=1)
    distance = (stacked * stacked).sum(axis=1)[:, None] - 2.0 * (stacked @ x.T)  # less the row's own square
    member, cost = np.empty(distance.shape), []
    for lo, hi in parts:
        least = distance[lo:hi].min(axis=0)
        np.equal(distance[lo:hi], least, out=member[lo:hi], casting="unsafe")
        cost.append(np.maximum(square + least, 0.0).sum())
    if member.sum() != len(parts) * len(x):  # centres equally near: the first one counts
        for lo, hi in parts:
            member[lo:hi] = np.arange(hi - lo)[:, None] == distance[lo:hi].argmin(axis=0)
    total = member @ np.column_stack([np.ones(len(x)), square, np.zeros(len(x)), x])
    total[[lo for lo, _ in parts], 2] = cost
    return total


def assign(df: DataFrame, columns: Sequence[str], model: Model, name: str = "cluster") -> DataFrame:
    """``df`` plus the number of the nearest centre."""
    return df.withColumn(name, nearest_center(columns, model))


def nearest_center(columns: Sequence[str], model: Model) -> Column:
    centers = model.centers

    @F.pandas_udf("int")
    def nearest(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([s.to_numpy(float) for s in batch])
            yield pd.Series(_distances(x, centers).argmin(axis=1).astype("int32"))

    return nearest(*[quoted(c) for c in columns])


def by_least_key(df: DataFrame, key: str, model: Model, name: str = "cluster") -> DataFrame:
    """Renumber clusters by their least key, so equal partitions read the same."""
    firsts = df.groupBy(name).agg(F.min(quoted(key)).alias("first")).collect()
    order = sorted((r for r in firsts if r["first"] is not None), key=lambda r: r["first"])
    number = [model.k] * model.k
    for new, row in enumerate(order):
        number[row[name]] = new
    return df.withColumn(name, F.get(F.array(*[F.lit(n) for n in number]), F.col(name)))


# -- choice of k -----------------------------------------------------------------


def select_k(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    max_k: int = 10,
    starts: int = STARTS,
    seed: int = 42,
) -> DataFrame:
    """``k, wcss, silhouette, best`` for k = 2..max_k; the first maximum is best.

    The silhouette is the squared Euclidean one, which needs the cluster sums only.
    """
    models = candidates(df, key, columns, max_k, starts, seed)
    return k_table(df, columns, models)


def candidates(df, key, columns, max_k: int = 10, starts: int = STARTS, seed: int = 42) -> list[Model]:
    return fit_many(df, key, columns, list(range(2, max_k + 1)), starts, seed)


def k_table(df, columns, models: Sequence[Model]) -> DataFrame:
    scores = silhouettes(df, columns, models)
    lines = [(m.k, float(m.cost), float(s)) for m, s in zip(models, scores)]
    best = best_k(models, scores)
    return df.sparkSession.createDataFrame(
        [(*line, line[0] == best) for line in lines], "k int, wcss double, silhouette double, best boolean"
    )


def best_k(models: Sequence[Model], scores: Sequence[float]) -> int:
    return models[int(np.argmax(scores))].k


def silhouettes(
    df: DataFrame, columns: Sequence[str], models: Sequence[Model]
) -> list[float]:
    """Mean silhouette of every model, all from one scan."""
    rows = int(models[0].sizes.sum())
    score = _squared_scores(models)
    names = [f"x{i}" for i in range(len(columns))]
    points = df.select(*[quoted(c).alias(n) for c, n in zip(columns, names)])

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            totals = score(batch[names].to_numpy(float))
            yield pd.DataFrame({"model": range(len(models)), "total": totals})

    sums = points.mapInPandas(per_batch, "model int, total double").groupBy("model").agg(F.sum("total").alias("total"))
    found = {r["model"]: r["total"] for r in sums.collect()}
    return [found.get(i, 0.0) / rows if (m.sizes > 0).sum() > 1 else 0.0 for i, m in enumerate(models)]


def _silhouette(within: np.ndarray, nearest: np.ndarray, alone: np.ndarray) -> np.ndarray:
    larger = np.maximum(within, nearest)
    score = np.divide(nearest - within, larger, out=np.zeros_like(within), where=larger > 0)
    return np.where(alone, 0.0, score)


def _squared_scores(models):
    """Squared distances to a cluster follow from its size, mean and norms."""

    def score(x: np.ndarray) -> list[float]:
        square = (x * x).sum(axis=1)[:, None]
        totals = []
        for model in models:
            label = _distances(x, model.centers).argmin(axis=1)
            sums = model.sizes * (square - 2.0 * x @ model.means.T) + model.norms
            totals.append(_from_sums(np.maximum(sums, 0.0), model.sizes, label).sum())
        return totals

    return score


def _from_sums(sums: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> np.ndarray:
    rows = np.arange(len(label))
    own = sizes[label]
    within = sums[rows, label] / np.maximum(own - 1, 1)
    mean = np.divide(sums, sizes, out=np.full_like(sums, np.inf), where=sizes > 0)
    mean[rows, label] = np.inf
    return _silhouette(within, mean.min(axis=1), own <= 1)


def elbow(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The k with the sharpest bend of a ``k, wcss`` curve.

    The bend at a k is the angle between the segments to its neighbours, taken as
    the steps (1, wcss[k-1] - wcss[k]) and (1, wcss[k+1] - wcss[k]). Curves are
    short; ``by`` names columns that tell several curves apart.
    """
    order = Window.partitionBy(*by).orderBy("k")
    before, after = F.lag("wcss").over(order), F.lead("wcss").over(order)
    bent = curve.withColumn("up", before - F.col("wcss")).withColumn("down", after - F.col("wcss"))
    bent = bent.where(F.col("up").isNotNull() & F.col("down").isNotNull())
    up, down = F.col("up"), F.col("down")
    cosine = (1 + up * down) / (F.sqrt(1 + up * up) * F.sqrt(1 + down * down))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    # equal angles: the first k wins
    return bent.groupBy(*by).agg(F.max_by("k", F.struct(angle, -F.col("k"))).alias("k"))
