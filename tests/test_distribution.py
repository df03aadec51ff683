import math

import numpy as np
import pytest

from gaugework.operators import distribution as D


@pytest.fixture
def gamma(long_frame):
    rng = np.random.default_rng(5)
    data = {"g": rng.gamma(2, 3, 500), "n": np.round(rng.normal(0, 5, 400)), "c": np.full(20, 4.0), "one": [2.0]}
    return data, long_frame({k: [*v, 0.0, None] for k, v in data.items()})


def test_histogram_equals_numpy(gamma):
    data, df = gamma
    rows = D.histogram(df).orderBy("metric_name", "bin").collect()
    assert len(rows) == 4 * 50
    for name, values in data.items():
        values = np.asarray(values)[np.asarray(values) != 0]
        counts, edges = np.histogram(values, bins=50)
        density, _ = np.histogram(values, bins=50, density=True)
        mine = [r for r in rows if r["metric_name"] == name]
        assert [r["n_values"] for r in mine] == counts.tolist()
        np.testing.assert_allclose([r["density"] for r in mine], density, rtol=1e-9)
        np.testing.assert_allclose([r["bin_left"] for r in mine], edges[:-1], rtol=1e-9, atol=1e-12)
        assert math.isclose(sum(r["density"] * (r["bin_right"] - r["bin_left"]) for r in mine), 1.0, rel_tol=1e-9)


def test_kde_by_definition(gamma):
    data, df = gamma
    rows = D.kde(df).orderBy("metric_name", "point").collect()
    assert {r["metric_name"] for r in rows} == {"g", "n"}
    values = data["g"]
    h = 0.5 * values.std(ddof=1)
    at = np.linspace(values.min(), values.max(), 100)
    expected = np.exp(-0.5 * ((at[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    mine = [r for r in rows if r["metric_name"] == "g"]
    np.testing.assert_allclose([r["x"] for r in mine], at)
    np.testing.assert_allclose([r["density"] for r in mine], expected, rtol=1e-9)


def test_kde_of_many_metrics_deals_their_values(spark, monkeypatch):
    """Beyond the grids a task may hold, values meet by metric, and a large metric is dealt in shares."""
    monkeypatch.setattr(D, "GRIDS", 2)
    monkeypatch.setattr(D, "SPLIT", 40)
    rng = np.random.default_rng(8)
    data = {f"m{i}": np.round(rng.gamma(2, 3, 30 + 400 * (i == 3)) + 0.1, 1) for i in range(6)}
    rows = [(k, float(x)) for k, values in data.items() for x in values]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    density = D.kde(spark.createDataFrame([*rows, (None, 1.0), (None, 2.0)], "metric_name string, value double").repartition(7))
    plan = density._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" in plan[plan.index("MapInPandas") :]
    found = density.collect()
    assert len(found) == 7 * 100
    for name, values in data.items():
        mine = sorted((r["point"], r["density"]) for r in found if r["metric_name"] == name)
        h = 0.5 * values.std(ddof=1)
        at = np.linspace(values.min(), values.max(), 100)
        expected = np.exp(-0.5 * ((at[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
        np.testing.assert_allclose([d for _, d in mine], expected, rtol=1e-9)


def test_markers_and_shape(gamma):
    import pandas as pd

    data, df = gamma
    marks = {r["metric_name"]: r for r in D.markers(df).collect()}
    assert math.isclose(marks["g"]["median"], np.median(data["g"]))
    assert math.isclose(marks["g"]["p75"], np.percentile(data["g"], 75))
    shapes = {r["metric_name"]: r for r in D.shape_with_zeros(df).collect()}
    with_zero = pd.Series([*data["g"], 0.0])
    assert math.isclose(shapes["g"]["skewness"], with_zero.skew(), rel_tol=1e-9)
    assert math.isclose(shapes["g"]["kurtosis"], with_zero.kurtosis(), rel_tol=1e-9)


def test_box_stats(spark):
    rows = [(0, float(v), 1.0) for v in [1, 2, 3, 4, 100]] + [(1, None, 2.0), (1, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    boxes = {(r["cluster"], r["feature"]): r for r in D.box_stats(df, ["a", "b"]).collect()}
    box = boxes[0, "a"]
    assert (box["q1"], box["median"], box["q3"]) == (2.0, 3.0, 4.0)
    assert (box["whisker_low"], box["whisker_high"], box["n_outside"]) == (1.0, 4.0, 1)
    assert boxes[1, "a"]["median"] == 5.0 and boxes[1, "b"]["n_outside"] == 0


def test_melt_keeps_missing(spark):
    df = spark.createDataFrame([(0, 1.0, None)], "cluster int, a double, b double")
    assert sorted((r["feature"], r["value"]) for r in D.melt(df, ["cluster"], ["a", "b"]).collect()) == [("a", 1.0), ("b", None)]
