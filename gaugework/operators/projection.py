"""Principal components of prepared features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from gaugework.functions.scalars import quoted


def _fitted(df: DataFrame, columns: Sequence[str], k: int):
    """Centred vectors, loadings with a fixed sign, explained variance shares."""
    means = df.agg(*[F.avg(quoted(c)) for c in columns]).first()
    names = [f"centered_{i}" for i in range(len(columns))]
    centred = df.select(
        "*", *[(quoted(c) - F.lit(m or 0.0)).alias(n) for c, m, n in zip(columns, means, names)]
    )
    vectors = VectorAssembler(inputCols=names, outputCol="vector_").transform(centred).drop(*names)
    model = PCA(k=min(k, len(columns)), inputCol="vector_").fit(vectors)
    loadings = model.pc.toArray()
    largest = np.abs(loadings).argmax(axis=0)
    sign = np.where(loadings[largest, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    return vectors, loadings * sign, model.explainedVariance.toArray()


def pca_points(df: DataFrame, columns: Sequence[str], keep: Sequence[str], k: int = 2) -> DataFrame:
    """``keep`` columns plus ``pc1..pck``, the centred projection of every row."""
    vectors, loadings, _ = _fitted(df, columns, k)
    x = vector_to_array("vector_")
    points = []
    for j in range(loadings.shape[1]):
        weights = F.array(*[F.lit(float(w)) for w in loadings[:, j]])
        total = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        points.append(total.alias(f"pc{j + 1}"))
    return vectors.select(*[quoted(c) for c in keep], *points)


def explained_variance(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Share of the variance per component."""
    _, _, shares = _fitted(df, columns, k)
    rows = [(i + 1, float(s)) for i, s in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance double")


def feature_importance(
    df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Absolute loadings of the first component."""
    _, loadings, _ = _fitted(df, columns, 1)
    rows = [(n, float(abs(w))) for n, w in zip(names or columns, loadings[:, 0])]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")
