"""Joins with keys that hold most rows."""

import pytest

from gaugework.operators.joins import join_hot


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_rare_missing_and_null_keys(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(900)] + [(k, k) for k in range(2, 50)] + [(None, 7)], "k long, x long")
    right = spark.createDataFrame([(k, -k) for k in range(1, 40)] + [(None, 1)], "k long, y long")
    found, wanted = (sorted(map(str, df.collect())) for df in (join_hot(left, right, "k", how), left.join(right, "k", how)))
    assert found == wanted
    assert join_hot(left.limit(0), right, "k", how).collect() == []
