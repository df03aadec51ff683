"""Outlier detection and clustering of a key/feature table, end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from gaugework.functions.scalars import quoted
from gaugework.operators import dbscan, kmeans, outliers
from gaugework.operators.features import METHODS as SCALINGS, fit_preparation, split
from gaugework.session import stored

KEYS = "_keys"  # several key columns as one
CLUSTERINGS = ("kmeans", "dbscan")
MIN_ROWS_TO_CHOOSE_K = 10


@dataclass(frozen=True)
class Clustering:
    """Settings of a run; unknown method names fail at once."""

    outlier_fraction: float = 0.1
    weights: Mapping[str, float] | Sequence[float] | None = None
    n_clusters: int = 3
    clustering_method: str = "kmeans"
    outlier_method: str | None = "isolation_forest"
    normalization_method: str = "standard"
    seed: int = 42

    def __post_init__(self):
        if self.clustering_method not in CLUSTERINGS:
            raise ValueError(f"unknown clustering method: {self.clustering_method}")
        if self.normalization_method not in SCALINGS:
            raise ValueError(f"unknown normalization method: {self.normalization_method}")
        if self.outlier_method is not None and self.outlier_method not in outliers.METHODS:
            raise ValueError(f"unknown outlier method: {self.outlier_method}")

    def prepare(self, df: DataFrame, key_col: str | None = None, features: Sequence[str] | None = None):
        return fit_preparation(df, key_col, features, self.normalization_method, self.weights)

    def flag(self, df: DataFrame, key_col: str | None = None, features: Sequence[str] | None = None):
        """The table with prepared columns and ``is_outlier``, and the preparation."""
        prep = self.prepare(df, key_col, features)
        flagged = outliers.flag_outliers(
            prep.beside(df), prep.key, prep.prepared, self.outlier_method, self.outlier_fraction, self.seed
        )
        return flagged, prep

    def fit_predict(
        self,
        df: DataFrame,
        auto_optimize: bool = False,
        key_col: str | Sequence[str] | None = None,
        features: Sequence[str] | None = None,
    ) -> DataFrame:
        """``df`` plus ``cluster``: -1 for outliers, 0.. for the clusters of the rest.

        ``auto_optimize`` picks the number of clusters when more than ten rows remain. Several key
        columns, such as source and metric, count as one key; keys order the cluster numbers and
        need not be unique, as every row is labelled for itself.
        """
        if key_col is not None and not isinstance(key_col, str):
            keys = list(key_col)
            if features is None:
                features = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)]
            packed = df.withColumn(KEYS, F.struct(*[quoted(c) for c in keys]))
            return self.fit_predict(packed, auto_optimize, KEYS, features).drop(KEYS)
        key, _ = split(df, key_col, features)
        flagged, prep = self.flag(df, key_col, features)
        flagged = stored(flagged)
        main, outlying = outliers.split_outliers(flagged)
        rows = main.count()
        if not rows:
            labelled = main.withColumn("cluster", F.lit(-1))
        elif self.clustering_method == "dbscan":
            labelled = dbscan.cluster(main, key, prep.prepared)
        else:
            model = self._model(main, key, prep.prepared, rows, auto_optimize)
            labelled = kmeans.by_least_key(kmeans.assign(main, prep.prepared, model), key, model)
        result = labelled.unionByName(outlying.withColumn("cluster", F.lit(-1)))
        return result.select(*[quoted(c) for c in df.columns], "cluster")

    def _model(self, main, key, columns, rows, auto_optimize):
        if auto_optimize and rows > MIN_ROWS_TO_CHOOSE_K:
            models = kmeans.candidates(main, key, columns, seed=self.seed)
            scores = kmeans.silhouettes(main, columns, models)
            return next(m for m in models if m.k == kmeans.best_k(models, scores))
        return kmeans.fit(main, key, columns, self.n_clusters, seed=self.seed)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Rows and share of the table per label, in label order."""
    counts = labelled.groupBy("cluster").agg(F.count("*").alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())  # over a row per label, not per point
    share = F.try_divide(F.col("n_rows"), total) * 100
    return counts.withColumn("percentage", share).orderBy("cluster")


def cluster_means(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of the raw features per label."""
    return labelled.groupBy("cluster").agg(*[F.avg(quoted(f)).alias(f) for f in features])


def distinct_labels(labelled: DataFrame) -> DataFrame:
    """How many labels occur, outliers included."""
    return labelled.agg(F.countDistinct("cluster").alias("n_labels"))


def outlier_points(flagged: DataFrame, key: str, prepared: Sequence[str]) -> DataFrame:
    """Key, first two prepared features and the outlier flag, for a scatter plot."""
    if len(prepared) < 2:
        raise ValueError("a scatter needs two features")
    return flagged.select(quoted(key), *[quoted(c) for c in prepared[:2]], "is_outlier")
