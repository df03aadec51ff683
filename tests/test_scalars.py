import datetime
import random

import pytest
from pyspark.sql import functions as F

from gaugework.functions import scalars as S


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, function, kind="double"):
    df = column(spark, values, kind).select("i", function(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_interpretations(spark):
    fair, some, high = "Fairly Symmetric", "Moderately Skewed", "Highly Skewed"
    assert apply(spark, [0.0, -0.49, 0.5, -0.99, 1.0, None, float("nan")], S.interpret_skewness) == [
        fair, fair, some, some, high, high, high,
    ]
    flat, peaked, normal = "Platykurtic (Flat)", "Leptokurtic (Peaked)", "Mesokurtic (Normal)"
    assert apply(spark, [-1.1, -1.0, 0.0, 1.0, 1.1, None, float("nan")], S.interpret_kurtosis) == [
        flat, normal, normal, normal, peaked, normal, normal,
    ]


@pytest.mark.parametrize(
    "value",
    [0.0, 1.0, -2.5, 0.1, 1e-3, 1.5e-4, 1e-5, -3.25e-7, 9999999.5, 12345678.25, 1e7, 123456789012.0, 1e15, 1e16,
     1.5e17, 1e100, 2.5e-300, float("inf"), float("-inf"), float("nan")],
)
def test_float_text_reads_like_python(spark, value):
    expected = str(value)
    assert apply(spark, [value], S.float_text) == [expected]


def test_two_decimals_keeps_missing(spark):
    assert apply(spark, [1.0, 2.346, None, float("nan")], S.two_decimals) == ["1.00", "2.35", None, None]


def test_name_prefix(spark):
    assert apply(spark, ["a.b.c", "plain"], S.name_prefix, "string") == ["a", "plain"]


def test_epoch_and_stamp(spark):
    got = apply(spark, [1704067200.0, 1704070800.5], S.epoch_to_timestamp)
    assert got == [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 1, 0, 0, 500000)]
    stamps = column(spark, [1704067200.0]).select(S.run_stamp(S.epoch_to_timestamp(F.col("v"))).alias("r"))
    assert stamps.first()["r"] == "2024-01-01_00-00-00"


def test_two_decimals_as_python_prints_them(spark):
    draw = random.Random(12)
    values = [draw.uniform(-1, 1) * 10.0 ** draw.randrange(-4, 28) for _ in range(3000)]
    values += [k / 8 for k in range(-40, 41)] + [k + 0.005 for k in range(200)] + [2.0**k + 0.5 for k in range(52)] + [-0.0, 0.0, -0.001, 1e13, 123456789012345.99, 2.0**63, 1e22, float("inf"), -float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", S.two_decimals(F.col("x")).alias("t")).collect():
        assert r["t"] == f"{r['x']:.2f}", r
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(S.two_decimals(F.col("x")).alias("t"))
    assert [r["t"] for r in odd.collect()] == [None, None]
