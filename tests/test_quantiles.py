import numpy as np
import pytest

from gaugework.operators import quantiles as Q

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def samples():
    rng = np.random.default_rng(7)
    heavy = np.concatenate([np.full(900, 3.5), rng.normal(size=50), np.full(400, -2.0)])
    return {
        "uniform": rng.uniform(-5, 5, 1500),
        "wide_range": 10.0 ** rng.uniform(-200, 200, 1200),
        "signed": np.sign(rng.normal(size=900)) * 10.0 ** rng.uniform(-9, 12, 900),
        "heavy_copies": heavy,
        "integers": rng.integers(0, 7, 1100).astype(float),
        "constant": np.full(700, 0.1),
        "two": np.array([5.0, 7.0]),
        "one": np.array([5.0]),
    }


@pytest.mark.parametrize("small_group,bins", [(None, Q.BINS), (40, 64), (1, 1024), (300, 512)])
def test_matches_numpy_on_every_path(spark, long_frame, small_group, bins):
    data = samples()
    df = long_frame({k: v.tolist() + [None] for k, v in data.items()}).repartition(5)
    found = Q.percentiles(df, ["metric_name"], "value", PROBS, small_group=small_group, bins=bins)
    got = {r["metric_name"]: r["q"] for r in found.collect()}
    assert set(got) == set(data)
    for name, values in data.items():
        expected = np.percentile(values, [100 * p for p in PROBS], method="linear")
        np.testing.assert_allclose(got[name], expected, rtol=1e-12)


def test_infinite_values(spark, long_frame):
    df = long_frame({"m": [float("-inf"), 1.0, 2.0, 3.0, 4.0, float("inf")] * 30})
    row = Q.percentiles(df, ["metric_name"], "value", (0.25, 0.5), small_group=10, bins=64).first()
    assert row["q"] == [1.0, 2.5]


def test_missing_only_groups_have_no_row(spark, long_frame):
    df = long_frame({"empty": [None, None], "full": [1.0]})
    assert [r["metric_name"] for r in Q.percentiles(df, ["metric_name"], "value", (0.5,)).collect()] == ["full"]
    assert Q.percentiles(long_frame({"empty": [None]}), ["metric_name"], "value", (0.5,)).count() == 0


def test_two_keys(spark):
    rows = [(s, m, float(i * 3 % 101)) for s in "ab" for m in "xyz" for i in range(200 if s == "a" else 7)]
    df = spark.createDataFrame(rows, "source string, metric_name string, value double")
    small = Q.percentiles(df, ["source", "metric_name"], "value", (0.25, 0.9)).orderBy("source", "metric_name")
    narrowed = Q.percentiles(df, ["source", "metric_name"], "value", (0.25, 0.9), small_group=5, bins=8)
    assert small.collect() == narrowed.orderBy("source", "metric_name").collect()
