import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugework.operators import clustering, dbscan, features, kmeans, outliers, projection, ranks, spacetree


def table(spark, x, parts=4):
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
    pdf.insert(0, "key", range(len(pdf)))
    return spark.createDataFrame(pdf).repartition(parts), [f"x{i}" for i in range(x.shape[1])]


def blobs(n=120, d=3, centers=((0, 0, 0), (6, 6, 6), (-6, 6, 0)), seed=0, spread=0.5):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, spread, (n, d)) for c in centers])


# -- preparation -----------------------------------------------------------------------


@pytest.fixture
def gaps(spark):
    rows = [("a", 1.0, 5.0, None, 1), ("b", None, 5.0, None, 2), ("c", 3.0, 5.0, None, 9), ("d", 10.0, 5.0, None, 4)]
    return spark.createDataFrame(rows, "metric_name string, x double, c double, e double, i int")


def prepared(df, **settings):
    return {r["metric_name"]: r for r in features.fit_preparation(df, **settings).only(df).collect()}


def test_impute(gaps, caplog):
    rows = {r["metric_name"]: r for r in features.impute_median(gaps, "metric_name", ["x", "c", "e", "i"]).collect()}
    assert rows["b"]["x"] == 3.0 and rows["b"]["e"] == 0.0 and rows["c"]["i"] == 9.0
    assert "without any value" in caplog.text


def test_standard(gaps):
    x = np.array([1.0, 3.0, 3.0, 10.0])
    rows = prepared(gaps)
    assert math.isclose(rows["d"]["x"], (10 - x.mean()) / x.std())
    assert rows["a"]["c"] == 0.0 and rows["a"]["e"] == 0.0


def test_robust_and_minmax(gaps):
    x = np.array([1.0, 3.0, 3.0, 10.0])
    q1, q3 = np.percentile(x, [25, 75])
    assert math.isclose(prepared(gaps, method="robust")["d"]["x"], (10 - 3) / (q3 - q1))
    assert prepared(gaps, method="robust")["d"]["c"] == 0.0
    assert math.isclose(prepared(gaps, method="minmax")["b"]["x"], 2 / 9)
    assert prepared(gaps, method="minmax")["b"]["c"] == 0.0


def test_weights(gaps):
    plain = prepared(gaps)["d"]
    named = prepared(gaps, weights={"x": 3.0, "misspelt": 9.0})["d"]
    assert math.isclose(named["x"], 3 * plain["x"]) and named["i"] == plain["i"]
    listed = prepared(gaps, weights=[0.0, 1.0, 1.0, 2.0])["d"]
    assert listed["x"] == 0.0 and math.isclose(listed["i"], 2 * plain["i"])
    with pytest.raises(ValueError):
        features.fit_preparation(gaps, weights=[1.0])
    with pytest.raises(ValueError):
        features.fit_preparation(gaps, method="other")


# -- outliers ------------------------------------------------------------------------------


def test_zscore(spark):
    x = np.random.default_rng(1).normal(size=(300, 2))
    x[7] = (9, 0)
    df, names = table(spark, np.column_stack([x, np.full(300, 2.0)]))
    got = {r["key"] for r in outliers.zscore_flags(df, names).where("is_outlier").collect()}
    z = np.abs((x - x.mean(axis=0)) / x.std(axis=0))
    assert got == set(np.flatnonzero((z > 3).any(axis=1)))


def test_isolation_forest_finds_planted(spark):
    x = np.concatenate([blobs(centers=((0, 0, 0),), n=600), [[15, 15, 15], [-14, 12, -9], [20, -20, 0]]])
    df, names = table(spark, x)
    flagged = outliers.isolation_forest_flags(df, "key", names, 0.05).where("is_outlier")
    got = {r["key"] for r in flagged.collect()}
    assert {600, 601, 602} <= got and abs(len(got) - 0.05 * 603) <= 1
    again = outliers.isolation_forest_flags(df.repartition(7), "key", names, 0.05).where("is_outlier")
    assert got == {r["key"] for r in again.collect()}


def test_isolation_forest_samples_without_replacement(spark):
    df, names = table(spark, np.random.default_rng(2).normal(size=(5000, 2)))
    drawn = outliers._tree_samples(df, "key", names, 5000, 256, 20, 42)
    counts = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("x0", "x1").alias("d")).collect()
    assert len(counts) == 20 and all(r["n"] == 256 and r["d"] == 256 for r in counts)


def test_outlier_methods(spark):
    df, names = table(spark, blobs(20))
    assert outliers.flag_outliers(df, "key", names, None).where("is_outlier").count() == 0
    with pytest.raises(ValueError):
        outliers.flag_outliers(df, "key", names, "other")


# -- density clusters ----------------------------------------------------------------------------


def brute_force(x, eps, min_points):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_points
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        waiting, label[i] = [i], number
        while waiting:
            j = waiting.pop()
            if core[j]:
                fresh = np.flatnonzero(near[j] & (label == -1))
                label[fresh] = number
                waiting += fresh.tolist()
        number += 1
    return label


@pytest.mark.parametrize("crowd,sample", [(2000, 200), (3, 4)])
def test_dbscan_equals_brute_force(spark, monkeypatch, crowd, sample):
    monkeypatch.setattr(dbscan, "CROWD", crowd)
    monkeypatch.setattr(dbscan, "SAMPLE", sample)
    rng = np.random.default_rng(0)
    for d, n, copies in ((2, 400, 150), (5, 200, 20)):
        x = np.concatenate([rng.normal(0, 0.6, (n // 2, d)), rng.normal(2, 0.3, (n // 3, d)), rng.uniform(-4, 6, (n // 4, d))])
        x = np.round(x[rng.permutation(len(x))], 2)
        x[10 : 10 + copies] = x[5]
        df, names = table(spark, x)
        expected = brute_force(x, 0.5, 5)
        got = dbscan.cluster(df, "key", names).orderBy("key").toPandas()["cluster"].to_numpy()
        assert (got == expected).all()
        noise = dbscan.noise_flags(df, "key", names).orderBy("key").toPandas()["is_outlier"].to_numpy()
        assert (noise == (expected == -1)).all()


def test_dbscan_long_chain_and_identical_rows(spark):
    chain = np.column_stack([np.arange(200) * 0.2, np.zeros(200)])
    df, names = table(spark, chain)
    assert [r["cluster"] for r in dbscan.cluster(df, "key", names).select("cluster").distinct().collect()] == [0]
    same, names = table(spark, np.ones((6, 2)))
    assert {r["cluster"] for r in dbscan.cluster(same, "key", names).collect()} == {0}
    assert {r["cluster"] for r in dbscan.cluster(same.where("key < 4"), "key", names).collect()} == {-1}


def test_dbscan_with_repeated_keys(spark):
    x = np.array([[c + 0.01 * i, 0.0] for c in (0, 100) for i in range(10)])
    df, names = table(spark, x)
    df = df.withColumn("key", (F.col("key") % 8).cast("int"))
    counts = dbscan.cluster(df, "key", names, eps=0.5).groupBy("cluster").count().collect()
    assert sorted(map(tuple, counts)) == [(0, 10), (1, 10)]
    same = df.withColumn("key", F.lit(None).cast("int"))
    assert {r["cluster"] for r in dbscan.cluster(same, "key", names, eps=0.5).collect()} == {0, 1}
    assert dbscan.noise_flags(same, "key", names, eps=0.5).where("is_outlier").count() == 0


def test_space_tree_reaches_every_neighbour():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.01, (400, 3)), rng.uniform(-5, 5, (400, 3)), np.zeros((50, 3))])
    tree = spacetree.SpaceTree(x[::2], 20)
    home = tree.home(x)
    assert 10 < tree.parts <= 64 and np.bincount(home).max() < 200
    reached = tree.reached(x - 0.3, x + 0.3)
    for i in range(0, len(x), 7):
        near = (np.abs(x - x[i]) <= 0.3).all(axis=1)
        assert set(home[near]) <= set(reached[i]) and len(set(reached[i])) == len(reached[i])
    assert spacetree.SpaceTree(np.zeros((100, 2)), 10).parts == 1


def test_numbered_is_the_order_of_the_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    assert [(r["v"], r["number"]) for r in ranks.numbered(df, ["v"]).orderBy("number").collect()] == [(i, i) for i in range(1000)]
    assert ranks.numbered(df.limit(0), ["v"]).count() == 0


def test_forest_samples_rows_not_keys(spark):
    df, names = table(spark, np.random.default_rng(3).normal(size=(4000, 2)))
    few = df.withColumn("key", F.col("key") % 3)
    counts = outliers._tree_samples(few, "key", names, 4000, 256, 10, 42).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("x0").alias("d")).collect()
    assert len(counts) == 10 and all(r["n"] == r["d"] == 256 for r in counts)
    copies = df.limit(2000).unionByName(df.limit(1).crossJoin(spark.range(2000)).drop("id"))
    shares = outliers._tree_samples(copies, "key", names, 4000, 256, 10, 42).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("x0").alias("d")).collect()
    assert all(r["n"] == 256 and 90 < r["d"] < 170 for r in shares)  # half of the rows are one point


# -- k-means -----------------------------------------------------------------------------------------


def test_kmeans_separates_blobs(spark):
    df, names = table(spark, blobs())
    model = kmeans.fit(df, "key", names, 3)
    got = kmeans.by_least_key(kmeans.assign(df, names, model), "key", model).orderBy("key").toPandas()["cluster"]
    assert got.tolist() == [0] * 120 + [1] * 120 + [2] * 120
    x = blobs()
    expected = sum(((x[i * 120 : (i + 1) * 120] - x[i * 120 : (i + 1) * 120].mean(axis=0)) ** 2).sum() for i in range(3))
    assert math.isclose(model.cost, expected, rel_tol=1e-6)


def test_kmeans_beyond_the_seed_rows(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "SEED_ROWS", 30)
    df, names = table(spark, blobs())
    model = kmeans.fit(df, "key", names, 3)
    assert sorted(model.sizes) == [120, 120, 120]


def exact_silhouette(x, label):
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)  # squared, the one formula at every size
    scores = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = distance[i, own].mean()
        b = min(distance[i, label == c].mean() for c in set(label) if c != label[i])
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def test_select_k(spark):
    x = blobs(60)
    df, names = table(spark, x)
    rows = kmeans.select_k(df, "key", names, max_k=5, starts=3).collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5] and [r["k"] for r in rows if r["best"]] == [3]
    assert all(a["wcss"] >= b["wcss"] for a, b in zip(rows, rows[1:]))
    model = kmeans.fit(df, "key", names, 3)
    label = kmeans._distances(x, model.centers).argmin(axis=1)
    assert math.isclose(kmeans.silhouettes(df, names, [model])[0], exact_silhouette(x, label), rel_tol=1e-6)


def test_squared_silhouette_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    df, names = table(spark, blobs(60, spread=2.0))
    model = kmeans.fit(df, "key", names, 4, starts=2)
    mine = kmeans.silhouettes(df, names, [model])[0]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(kmeans.assign(df, names, model, "prediction"))
    assert math.isclose(mine, ClusteringEvaluator().evaluate(vectors), rel_tol=1e-6)


@pytest.mark.parametrize(
    ("wcss", "bend"),
    [([100.0, 20.0, 18.0, 17.5], 3), ([10.0, 9.9, 5.0, 1.0], 4), ([50.0, 40.0, 10.0, 9.0], 3)],  # worked by hand
)
def test_elbow(spark, wcss, bend):
    curve = spark.createDataFrame([(k, w) for k, w in enumerate(wcss, start=2)], "k int, wcss double")
    assert kmeans.elbow(curve).first()["k"] == bend


# -- together -----------------------------------------------------------------------------------------


def test_fit_predict(spark):
    x = np.concatenate([blobs(60, seed=3), [[40, -40, 40]]])
    df, names = table(spark, x)
    df = df.withColumn("key", F.concat(F.lit("m."), F.lpad("key", 4, "0"))).withColumn("x3", F.lit(None).cast("double"))
    run = clustering.Clustering(outlier_method="zscore", n_clusters=3)
    got = run.fit_predict(df).orderBy("key").toPandas()
    assert list(got.columns) == ["key", "x0", "x1", "x2", "x3", "cluster"]
    assert got["cluster"].tolist() == [0] * 60 + [1] * 60 + [2] * 60 + [-1]
    auto = run.fit_predict(df, auto_optimize=True)
    assert {r["cluster"] for r in auto.collect()} == {-1, 0, 1, 2}
    density = clustering.Clustering(outlier_method="zscore", clustering_method="dbscan").fit_predict(df)
    assert {-1, 0, 1, 2} <= {r["cluster"] for r in density.collect()}
    sizes = {r["cluster"]: r for r in clustering.cluster_sizes(auto).collect()}
    assert sizes[-1]["n_rows"] == 1 and math.isclose(sum(r["percentage"] for r in sizes.values()), 100.0)
    assert clustering.distinct_labels(auto).first()["n_labels"] == 4
    means = {r["cluster"]: r["x0"] for r in clustering.cluster_means(auto, ["x0"]).collect()}
    assert means[-1] == 40.0


def test_settings_are_checked():
    for bad in ({"clustering_method": "other"}, {"outlier_method": "other"}, {"normalization_method": "other"}):
        with pytest.raises(ValueError):
            clustering.Clustering(**bad)


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * (5, 1, 0.1) + 50
    df, names = table(spark, x)
    points = projection.pca_points(df, names, ["key"]).orderBy("key").toPandas()
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    first = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    np.testing.assert_allclose(points["pc1"], centred @ first, atol=1e-6)
    shares = [r["explained_variance"] for r in projection.explained_variance(df, names).collect()]
    np.testing.assert_allclose(shares, values[::-1][:2] / values.sum(), rtol=1e-6)
    importance = {r["feature"]: r["importance"] for r in projection.feature_importance(df, names).collect()}
    assert max(importance, key=importance.get) == "x0"


def test_several_key_columns(spark):
    x = blobs(30, 2, centers=((0, 0), (9, 9)))
    df, names = table(spark, x)
    both = df.withColumn("source", F.when(F.col("key") % 2 == 0, "s").otherwise("t")).withColumn("key", (F.col("key") / 2).cast("int"))
    for method in ("kmeans", "dbscan"):
        run = clustering.Clustering(outlier_method=None, clustering_method=method, n_clusters=2)
        found = run.fit_predict(both, key_col=["source", "key"], features=names)
        assert found.columns == [*both.columns, "cluster"]
        rows = found.groupBy((F.col("x0") > 4.5).alias("far"), "cluster").count().where("cluster >= 0").collect()
        assert len(rows) == 2 and {r["cluster"] for r in rows} == {0, 1}


def test_starts_on_the_same_centres_are_one_model(spark, monkeypatch):
    rng = np.random.default_rng(4)
    near = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(c, 0.1, (40, 2)) for c in (0, 10, 25)]))]
    df = spark.createDataFrame(near, "id int, a double, b double")
    asked, plain = [], kmeans._pass

    def counted(points, size, models):
        asked.append(len(models))
        return plain(points, size, models)

    monkeypatch.setattr(kmeans, "_pass", counted)
    two, three = kmeans.fit_many(df, "id", ["a", "b"], [2, 3])
    assert asked[0] < 20
    x = np.array([r[1:] for r in near])
    for model in (two, three):
        nearest = ((x[:, None] - model.centers) ** 2).sum(axis=2)
        label = nearest.argmin(axis=1)
        assert model.sizes.tolist() == np.bincount(label, minlength=model.k).tolist()
        np.testing.assert_allclose(model.means, [x[label == i].mean(axis=0) for i in range(model.k)], rtol=1e-9)
        np.testing.assert_allclose(model.cost, nearest.min(axis=1).sum(), rtol=1e-9)
    assert sorted(three.sizes) == [40, 40, 40]


def test_a_pass_is_one_stage_over_all_cores(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "SEED_ROWS", 60)
    monkeypatch.setattr(kmeans, "TASK_BLOCKS", 1)
    x = np.random.default_rng(8).normal(size=(6_000, 2))
    df, names = table(spark, x)
    context, plain, ran = spark.sparkContext, kmeans._pass, []

    def watched(points, size, models):
        context.setJobGroup(f"pass {len(ran)}", "")
        totals = list(plain(points, size, models))
        context.setLocalProperty("spark.jobGroup.id", None)
        context._jsc.sc().listenerBus().waitUntilEmpty()
        tracker = context.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(f"pass {len(ran)}") for s in tracker.getJobInfo(j).stageIds]
        tasks = [tracker.getStageInfo(s).numCompletedTasks for s in stages]
        ran.append([n for n in tasks if n])  # stages that are read again have none
        return totals

    monkeypatch.setattr(kmeans, "_pass", watched)
    model = kmeans.fit(df.coalesce(1), "key", names, 4, starts=2)
    assert len(ran) > 3
    assert ran[1:] == [[min(context.defaultParallelism, 6)]] * (len(ran) - 1)  # six blocks of rows
    label = ((x[:, None] - model.centers) ** 2).sum(axis=2).argmin(axis=1)
    assert model.sizes.tolist() == np.bincount(label, minlength=4).tolist()
    np.testing.assert_allclose(model.means, [x[label == i].mean(axis=0) for i in range(4)], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("at_once", [kmeans.DRIVER_VALUES, 0])  # 0: tasks add up sums before the driver does
def test_rows_between_equal_centres_count_once(spark, monkeypatch, at_once):
    monkeypatch.setattr(kmeans, "DRIVER_VALUES", at_once)
    x = blobs(50, 2, centers=((0, 0), (9, 9)))
    df, names = table(spark, x, 9)
    model = kmeans.from_centers(df, names, [[0, 0], [0, 0], [9, 9], [9, 9]])
    assert model.sizes.tolist() == [50, 0, 50, 0]
    expected = ((x - np.repeat([[0, 0], [9, 9]], 50, axis=0)) ** 2).sum()
    assert math.isclose(model.cost, expected, rel_tol=1e-9)
    assert kmeans.from_centers(df.limit(0), names, [[0, 0], [9, 9]]).sizes.tolist() == [0, 0]


@pytest.mark.parametrize("k", [2, 5, 9])
def test_starts_settle_as_plain_passes_do(k):
    x = np.random.default_rng(k).normal(size=(700, 3))
    x[::7] = x[0]  # a point that many rows share
    centers = np.vstack([x[1:k], [[50.0, 50.0, 50.0]]])  # the last one has no rows
    expected = centers
    while True:
        label = ((x[:, None] - expected) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[label == i].mean(axis=0) if (label == i).any() else expected[i] for i in range(k)])
        if np.allclose(moved, expected, rtol=0, atol=1e-13):
            break
        expected = moved
    np.testing.assert_allclose(kmeans._at_rest(x, centers), expected, rtol=1e-9, atol=1e-12)
