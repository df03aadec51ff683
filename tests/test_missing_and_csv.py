"""Missing values and keys in long tables, limits in counts, CSV cells, exact decimals."""

from gaugework.functions.predicates import column_condition
from gaugework.functions.scalars import two_decimals
from gaugework.operators import distribution, profile
from gaugework.plans.groups import ReportBuilder
from gaugework.sources import metrics, sinks


def test_long_tables_with_nan_and_null_keys(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", 4.0), (None, 3.0), (None, 0.0)]
    long = spark.createDataFrame(rows, "metric_name string, value double")
    for mode in ("exact", "approx"):
        found = {r["metric_name"]: r for r in profile.profile(long, quantile_mode=mode).collect()}
        assert set(found) == {"a", None}
        assert found["a"]["max"] == 4 and found["a"]["null_count"] == 1 and found["a"]["total_records"] == 3
    bins = distribution.histogram(long).where("n_values > 0").collect()
    assert sum(r["n_values"] for r in bins) == 4 and all(r["density"] > 0 for r in bins)
    assert {r["metric_name"]: r["median"] for r in distribution.markers(long).collect()} == {"a": 2.0, None: 3.0}


def test_counts_and_categories_follow_limits(spark):
    table = spark.createDataFrame([(f"g{i % 5}.m{i}", float(i)) for i in range(50)], "metric_name string, p95 double")
    builder = ReportBuilder(table).create_filter_group("top").add_column_filter("p95", ">", 9)
    builder.set_sorting(["p95"], ascending=False).limit_rows(3)
    builder.create_filter_group("low").add_column_filter("p95", "<", 2)
    assert dict(map(tuple, builder.group_counts().collect())) == {"top": 3, "low": 2}
    assert sorted(map(tuple, builder.affected_categories().collect())) == [("low", "g0"), ("low", "g1"), ("top", "g2"), ("top", "g3"), ("top", "g4")]


def test_csv_cells_survive(spark, tmp_path):
    rows = [("  a  ", 'say "hi"', "1"), ("line\nbreak", "x,y", "2")]
    path = sinks.write_csv(spark.createDataFrame(rows, "t string, u string, n string"), str(tmp_path / "cells.csv"))
    back = metrics.read_text(spark, path, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_files_are_joined_by_column_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("ts,a,b\n1,10,20\n")
    (tmp_path / "two.csv").write_text("ts,b,a\n2,21,11\n")
    back = metrics.read_text(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    assert sorted((r["ts"], r["a"], r["b"]) for r in back.collect()) == [("1", "10", "20"), ("2", "11", "21")]


def test_two_decimals_round_the_exact_value(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1.005,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(two_decimals(df["x"])).collect()] == ["0.12", "2.67", "1.00", "2.50", None]


def test_other_types_match_nothing(spark):
    df = spark.createDataFrame([("a",), ("3",), (None,)], "x string")
    for operator, value, wanted in (("==", 3, 0), (">", 1, 0), ("!=", 3, 3), ("in", [3, "a"], 1), ("not in", [3], 3)):
        assert df.where(column_condition("x", operator, value)(df)).count() == wanted, operator
