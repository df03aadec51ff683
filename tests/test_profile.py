import math

import numpy as np
import pandas as pd
import pytest

from gaugework.operators import correlation as C
from gaugework.operators import profile as P
from gaugework.sources.metrics import MetricFrame, from_table, read_csv, read_table, union_sources

# Expected statistics of hand-written series.
EDGES = {
    "six": ([1, 2, 4, 8, 16, 3], 6, 5.609515724790034, 1.6002620111364843, 2.3356704251651816, 1.25, 2.25),
    "one": ([5], 1, None, None, None, 5.0, 5.0),
    "two": ([5, 7], 2, 1.4142135623730951, None, None, 5.1, 5.5),
    "three": ([1, 2, 9], 3, 4.358898943540674, 1.6300591617118865, None, 1.1, 1.5),
    "constant": ([3, 3, 3, 3, 3], 5, 0.0, 0.0, 0.0, 3.0, 3.0),
}


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


@pytest.mark.parametrize("small_group", [None, 2])
def test_edge_series(long_frame, small_group):
    data = {name: [*values, 0, None] for name, (values, *_) in EDGES.items()}
    data["zeros"], data["missing"] = [0, 0], [None]
    rows = {r["metric_name"]: r for r in P.profile(long_frame(data), small_group=small_group).collect()}
    assert set(rows) == set(EDGES)
    for name, (_, n, std, skew, kurt, p05, p25) in EDGES.items():
        row = rows[name]
        assert row["non_zero_records"] == n and row["zero_count"] == 1 and row["null_count"] == 1
        assert row["total_records"] == n + 1
        assert near(row["null_percentage"], 100 / (n + 2)) and near(row["zero_percentage"], 100 / (n + 1))
        for field, expected in (("std_dev", std), ("skewness", skew), ("kurtosis", kurt), ("p05", p05), ("p25", p25)):
            assert near(row[field], expected), (name, field, row[field])


def test_field_order(long_frame):
    assert tuple(P.profile(long_frame({"m": [1]})).columns) == P.PROFILE_FIELDS


def test_wide_equals_long(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=300, freq="h")})
    for i in range(10):
        pdf[f"m{i}"] = np.where(rng.random(300) < 0.1, np.nan, np.round(rng.gamma(2, 3, 300)))
    few = from_table(spark.createDataFrame(pdf), metrics=["m0", "m1", "m2"])
    many = from_table(spark.createDataFrame(pdf))
    wide = {r["metric_name"]: r.asDict() for r in P.profile(few).collect()}
    long = {r["metric_name"]: r.asDict() for r in P.profile(many).collect()}
    assert len(long) == 10
    for name, row in wide.items():
        series = pdf[name].dropna()
        series = series[series != 0]
        for field, value in row.items():
            assert value == long[name][field] or math.isclose(value, long[name][field], rel_tol=1e-9)
        assert math.isclose(row["skewness"], series.skew(), rel_tol=1e-9)
        assert math.isclose(row["kurtosis"], series.kurtosis(), rel_tol=1e-9)
        assert math.isclose(row["iqr"], series.quantile(0.75) - series.quantile(0.25), rel_tol=1e-9)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), True), (2, 4.0, False), (3, None, True)], "t long, m double, flag boolean")
    frame = from_table(df)
    assert frame.metrics == ("m",)
    row = P.profile(frame).first()
    assert row["null_count"] == 2 and row["mean"] == 4.0 and row["max"] == 4.0


def test_unknown_metric_and_mode(spark, long_frame):
    frame = from_table(spark.createDataFrame([(1, 2.0)], "t long, m double"))
    assert P.metric_profile(frame, "absent") is None
    assert P.metric_profile(frame, "m").first()["mean"] == 2.0
    with pytest.raises(ValueError):
        P.profile(frame, quantile_mode="guess")


def test_approximate_quantiles(long_frame):
    row = P.profile(long_frame({"m": range(1, 1001)}), quantile_mode="approx").first()
    assert abs(row["median"] - 500.5) <= 1 and abs(row["p95"] - 950) <= 1


def test_overview_counts_whole_days(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-01 23:00:00' AS ts, 1.0D AS a, 0.0D AS b UNION ALL SELECT timestamp'2024-01-02 01:00:00', 2.0D, 0.0D"
    )
    frame = from_table(df)
    row = P.overview(frame).first()
    assert (row["total_metrics"], row["total_timestamps"], row["time_span_days"]) == (2, 2, 0)
    long = P.overview_long(union_sources({"s": frame}), keys=("source",)).first()
    assert (long["total_metrics"], long["total_timestamps"], long["time_span_days"]) == (2, 2, 0)


def test_summary(long_frame):
    row = P.summary(P.profile(long_frame({"a": [0, 1, None], "b": [1, 2]}))).first()
    assert (row["total_metrics_analyzed"], row["metrics_with_zeros"]) == (2, 1)
    assert row["avg_zero_percentage"] == 25.0 and math.isclose(row["avg_null_percentage"], 100 / 6)
    empty = P.summary(P.profile(long_frame({"a": [0]}))).first()
    assert empty["total_metrics_analyzed"] == 0 and empty["avg_zero_percentage"] is None


def correlations(df):
    return {(r["metric_a"], r["metric_b"]): r["corr"] for r in df.collect()}


def test_correlation_masks_zeros_and_constants(spark):
    rows = [(i, float(a), float(b), 7.0) for i, (a, b) in enumerate(zip([1, 2, 0, 4, 5], [2, 0, 3, 9, 10]))]
    frame = from_table(spark.createDataFrame(rows, "t long, a double, b double, c double"))
    got = correlations(C.correlation(frame))
    assert len(got) == 9
    assert math.isclose(got["a", "b"], 0.99187, abs_tol=1e-5) and got["a", "b"] == got["b", "a"]
    assert math.isclose(got["a", "a"], 1.0)
    assert got["a", "c"] is None and got["c", "c"] is None
    wide = {r["metric_name"]: r for r in C.correlation_wide(frame).collect()}
    assert math.isclose(wide["b"]["a"], got["a", "b"]) and wide["c"]["a"] is None


def test_correlation_agrees_with_pandas(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(1e6, 1, (400, 1))
    pdf = pd.DataFrame(base + rng.normal(size=(400, 5)), columns=list("abcde"))
    pdf[rng.random((400, 5)) < 0.1] = np.nan
    expected = pdf.corr()
    pdf.insert(0, "t", range(400))
    frame = from_table(spark.createDataFrame(pdf))
    for cells in (C.CELLS, 10):  # one band of metrics, and several
        monkeypatch.setattr(C, "CELLS", cells)
        found = correlations(C.correlation(frame))
        assert len(found) == 25
        for (a, b), value in found.items():
            assert math.isclose(value, expected.loc[a, b], abs_tol=1e-9)


def test_correlation_of_a_nearly_constant_pair_at_any_width(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(300, 13)) + 5, columns=list("abcdefghijklm"))
    a, b = np.full(300, np.nan), np.full(300, np.nan)
    a[:20] = 1000 + 1e-5 * np.arange(20)
    a[20:], b[:20] = rng.normal(0, 1e5, 280), a[:20] * 2 + 1e-6 * rng.normal(size=20)
    pdf["a"], pdf["b"] = a, b
    pdf["c"] = np.where(np.arange(300) < 20, 0.1, pdf["c"])
    expected = pdf["a"][:20].corr(pdf["b"][:20])
    for width in (12, 13):
        frame = from_table(spark.createDataFrame(pdf.iloc[:, :width].reset_index(names="t")))
        found = correlations(C.correlation(frame))
        assert math.isclose(found["a", "b"], expected, abs_tol=1e-6) and expected > 0.9
        assert found["c", "b"] is None and math.isclose(found["b", "b"], 1.0)


def test_csv_types_and_missing_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "timestamp,a.b,flag,gap,text,whole\n"
        "1704067200,1.5,true,,x,1\n1704070800.5,NaN,false,NA,y,2\n1704074400,3e2,true,null,1,-3\n"
    )
    frame = read_csv(spark, str(tmp_path / "m.csv"))
    assert frame.metrics == ("a.b", "gap", "whole")
    rows = frame.df.orderBy("timestamp").collect()
    assert [r["a.b"] for r in rows] == [1.5, None, 300.0]
    assert str(rows[0]["timestamp"]) == "2024-01-01 00:00:00" and rows[1]["timestamp"].microsecond == 500000
    assert [r["metric_name"] for r in P.profile(frame).orderBy("metric_name").collect()] == ["a.b", "whole"]
    named = read_csv(spark, str(tmp_path / "m.csv"), metrics=["whole"])
    assert named.metrics == ("whole",) and named.df.count() == 3
    assert dict(read_table(spark, str(tmp_path / "m.csv")).dtypes)["text"] == "string"


def test_csv_text_timestamps(spark, tmp_path):
    (tmp_path / "m.csv").write_text("time,m\n2024-01-01 10:00:00,1\n2024-01-03 09:00:00,2\n")
    row = P.overview(read_csv(spark, str(tmp_path / "m.csv"))).first()
    assert row["time_span_days"] == 1 and row["total_metrics"] == 1


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "absent.csv"))


def test_null_counts_and_describe(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (3.0, "c"), (None, "d")], "x double, s string")
    assert {r["column_name"]: r["missing"] for r in P.null_counts(df).collect()} == {"x": 2, "s": 1}
    row = P.describe(df, ["x"]).first()
    assert (row["n"], row["mean"], row["p25"], row["p50"], row["max"]) == (2, 2.0, 1.5, 2.0, 3.0)


def test_only_prunes_metrics(spark):
    frame = MetricFrame(spark.createDataFrame([(1, 2.0, 3.0)], "t long, a double, b double"), "t", ("a", "b"))
    assert frame.only(["b"]).df.columns == ["t", "b"]
