"""Correlation from mergeable co-moments."""

import numpy as np
import pandas as pd
import pytest

from gaugework.operators import correlation
from gaugework.sources.metrics import from_table


def matrix(df):
    return df.toPandas().pivot(index="metric_a", columns="metric_b", values="corr")


def frame(spark, x, parts=3):
    names = [f"m{i:04d}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names)
    pdf.insert(0, "ts", range(len(pdf)))
    return from_table(spark.createDataFrame(pdf).repartition(parts)), pdf[names].replace(0.0, np.nan)


def test_states_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1.0, (90, 5))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[:, 4] = np.where(np.isnan(x[:, 4]), np.nan, 3.1)
    whole = correlation.batch_state(x, 5)
    parts = [correlation.batch_state(p, 5) for p in np.array_split(x, 7)] + [correlation.batch_state(x[:0], 5)]
    for order in (range(8), (7, 3, 0, 1, 6, 2, 5, 4)):
        total = np.zeros((correlation.STATE, 5, 5))
        for k in order:
            total = correlation.merge_states(total, parts[k])
        np.testing.assert_allclose(total, whole, rtol=1e-7, atol=1e-7)
    assert (whole[3, 4] == 0).all()  # a constant column deviates by nothing


def test_sparse_wide_table_without_a_second_scan(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 150))
    x[rng.random(x.shape) < 0.97] = np.nan
    monkeypatch.setattr(correlation, "CELLS", 150 * 64)  # several bands
    monkeypatch.setattr(correlation, "GROUP", 2)  # several rounds of merging
    data, pdf = frame(spark, x, 5)
    found = matrix(correlation.correlation(data))
    wanted = pdf.corr(min_periods=2)
    np.testing.assert_allclose(found.to_numpy(float), wanted.to_numpy(float), atol=1e-9)


def test_near_constant_pairs_equal_pandas(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1e8, 300)
    b = np.full(300, np.nan)
    a[:60] = 7e8 + rng.normal(0, 1e-3, 60)  # far off, and steady where b is
    b[:60] = 0.5 * (a[:60] - 7e8) + rng.normal(0, 1e-4, 60) + 3e5
    c = np.where(np.arange(300) < 40, 0.1, np.nan)
    data, _ = frame(spark, np.column_stack([a, b, c]))
    found = matrix(correlation.correlation(data))
    assert found.iloc[0, 1] == pytest.approx(np.corrcoef(a[:60], b[:60])[0, 1], abs=1e-6)
    assert found.isna().iloc[2].all() and found.iloc[0, 0] == pytest.approx(1.0)
