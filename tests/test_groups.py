import pytest
from pyspark.sql import functions as F

from gaugework.functions.predicates import column_condition
from gaugework.plans.groups import ReportBuilder, from_constraints
from gaugework.plans.reports import metric_report

NAN = float("nan")


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, NAN)], "id int, x double")


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(0, "a.b"), (1, None), (2, "cXb")], "id int, s string")


def kept(df, *condition):
    result = ReportBuilder(df).create_filter_group("g").add_column_filter(*condition).build_single()
    return sorted(r["id"] for r in result.collect())


@pytest.mark.parametrize(
    "operator,value,expected",
    [
        ("==", 1, [0]), ("!=", 1, [1, 2, 3]), (">", 1, [2]), ("<", 3, [0]), (">=", 1, [0, 2]), ("<=", 1, [0]),
        ("in", [1, 5], [0]), ("in", [], []), ("in", [None], [1, 3]), ("in", [3, NAN], [1, 2, 3]),
        ("not in", [1], [1, 2, 3]), ("not in", [None], [0, 2]), ("isna", None, [1, 3]), ("notna", None, [0, 2]),
        ("==", NAN, []), ("!=", NAN, [0, 1, 2, 3]), (">", NAN, []),
    ],
)
def test_numeric_operators(numbers, operator, value, expected):
    assert kept(numbers, "x", operator, value) == expected


@pytest.mark.parametrize(
    "operator,value,expected",
    [
        ("contains", "c.b", [2]), ("contains", "b", [0, 2]), ("startswith", "a.", [0]), ("startswith", ".", []),
        ("endswith", "Xb", [2]), ("==", "cXb", [2]), ("!=", "cXb", [0, 1]), ("in", [None, "a.b"], [0, 1]),
        ("not in", ["a.b"], [1, 2]), ("isna", None, [1]),
    ],
)
def test_text_operators(texts, operator, value, expected):
    assert kept(texts, "s", operator, value) == expected


def test_bad_operator_fails_when_declared(numbers):
    with pytest.raises(ValueError, match="no filter operator"):
        ReportBuilder(numbers).create_filter_group("g").add_column_filter("x", "~", 1)
    with pytest.raises(TypeError):
        ReportBuilder(numbers).create_filter_group("g").add_column_filter("x", "contains", "1").build_single()


def test_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") / 3).alias("x"), F.lit(1).alias("unused")).write.parquet(path)
    builder = ReportBuilder(spark.read.parquet(path)).create_filter_group("g").add_column_filter("x", ">", 10.0)
    plan = builder.select_columns(["id"]).build_single()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,10.0)]" in plan
    assert "ReadSchema: struct<id:bigint,x:double>" in plan


def test_range(numbers):
    def ids(**ends):
        return sorted(r["id"] for r in ReportBuilder(numbers).create_filter_group("g").add_range_filter("x", **ends).build_single().collect())

    assert ids(min_val=1, max_val=3) == [0, 2]
    assert ids(min_val=2) == [2] and ids(max_val=1) == [0]
    assert ids() == [0, 1, 2, 3]


def test_sorting_puts_missing_last(numbers):
    builder = ReportBuilder(numbers).create_filter_group("g")
    assert [r["id"] for r in builder.set_sorting(["x"]).add_sort_column("id").build_single().collect()] == [0, 2, 1, 3]
    descending = builder.set_sorting(["x"], ascending=False).add_sort_column("id", ascending=False)
    assert [r["id"] for r in descending.build_single().collect()] == [2, 0, 3, 1]


def test_limit_ties_and_zero(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id int, x int").repartition(4)
    builder = ReportBuilder(df, tie_key="id").create_filter_group("g").set_sorting(["x"], ascending=False)
    assert [r["id"] for r in builder.limit_rows(3).build_single().collect()] == [1, 3, 5]
    assert builder.limit_rows(0).build_single().count() == 20
    with pytest.raises(ValueError):
        builder.limit_rows(-1)
    assert "TakeOrderedAndProject" in builder.limit_rows(3).build_single()._jdf.queryExecution().executedPlan().toString()


def test_order_of_steps(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id int, x int")
    builder = ReportBuilder(df).create_filter_group("g")
    builder.add_transformation(lambda d: d.withColumn("y", F.col("x") * 2))
    builder.add_column_filter("y", ">", 10).set_sorting(["y"], ascending=False).select_columns(["id"]).limit_rows(2)
    assert [r["id"] for r in builder.build_single().collect()] == [9, 8]


def test_groups_reset_switch_and_order(numbers):
    builder = ReportBuilder(numbers)
    builder.create_filter_group("a", "first").add_column_filter("x", ">", 1)
    builder.create_filter_group("b").add_column_filter("x", "==", 1)
    assert list(builder.build_all()) == ["a", "b"]
    assert builder.switch_group("a").build_single().count() == 1
    assert builder.get_group_configuration().description == "first"
    builder.create_filter_group("a")
    assert builder.build_single("a").count() == 4
    for bad in (builder.switch_group, builder.build_single, builder.get_group_configuration):
        with pytest.raises(ValueError):
            bad("absent")


def test_combined(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, 5.0)], "id int, x double")
    builder = ReportBuilder(df)
    builder.create_filter_group("low").add_column_filter("x", "<", 3)
    builder.create_filter_group("one").add_column_filter("id", "==", 1).limit_rows(1)
    builder.create_filter_group("odd").add_filter(lambda d: d["id"] % 2 == 1)

    def ids(names, operation):
        return sorted(r["id"] for r in builder.build_combined(names, operation).collect())

    assert ids(["low", "one"], "intersection") == [1, 1]
    assert ids(["low", "odd"], "union") == [1, 1, 3]
    assert ids([], "intersection") == [1, 1, 2, 3] and ids([], "union") == []
    with pytest.raises(ValueError):
        builder.build_combined(["low"], "difference")
    with pytest.raises(ValueError):
        builder.build_combined(["absent"])


def test_tagged_equals_single_results(numbers):
    builder = ReportBuilder(numbers)
    builder.create_filter_group("a").add_column_filter("x", "!=", 1)
    builder.create_filter_group("b").add_column_filter("x", "notna")
    builder.create_filter_group("c").add_transformation(lambda d: d.withColumn("y", F.col("x") + 1)).add_column_filter("y", ">", 2)
    tagged = builder.build_tagged()
    counts = {r["group_name"]: r["n_rows"] for r in builder.group_counts().collect()}
    assert counts == {n: df.count() for n, df in builder.build_all().items()}
    assert set(tagged.columns) == {"group_name", "id", "x", "y"}


def test_summary(numbers, spark):
    builder = ReportBuilder(numbers)
    builder.create_filter_group("a", "text").add_column_filter("x", "notna").limit_rows(1).set_sorting(["x"], ascending=False)
    builder.create_filter_group("b").add_transformation(lambda d: d.where("id < 3")).select_columns(["id"])
    rows = {r["group_name"]: r for r in builder.get_summary_report().collect()}
    a, b = rows["a"], rows["b"]
    assert (a["filter_count"], a["row_limit"], a["selected_columns"], a["sort_columns"]) == (1, "1", "All", "['x']")
    assert (a["original_rows"], a["filtered_rows"], a["remaining_percentage"], a["sort_ascending"]) == (4, 1, 25.0, False)
    assert (b["original_rows"], b["filtered_rows"], b["row_limit"], b["transformations_count"]) == (4, 3, "No limit", 1)
    empty = ReportBuilder(numbers.where("id > 9"))
    empty.create_filter_group("a")
    assert empty.get_summary_report().first()["remaining_percentage"] is None


def test_constraints(spark):
    df = spark.createDataFrame([(1, "N"), (5, "N"), (5, "S")], "x int, region string")
    rows = [
        {"group": "u", "column": "x", "op": ">", "value": 2},
        {"group": "u", "column": "region", "op": "in", "value": ["N"]},
    ]
    assert from_constraints(df, rows).build_single("u").count() == 2
    assert from_constraints(df, rows, reset=False).build_single("u").count() == 1


def test_column_condition_is_reusable(numbers):
    condition = column_condition("x", ">", 0)
    builder = ReportBuilder(numbers).create_filter_group("g").add_multiple_filters([condition, "id > 0", F.col("id") < 9])
    assert [r["id"] for r in builder.build_single().collect()] == [2]


def test_shipped_report_on_empty_profile(long_frame):
    from gaugework.operators.profile import profile

    builder = metric_report(ReportBuilder(profile(long_frame({"m": [0]}))))
    results = builder.build_all()
    assert list(results) == ["max_response_time", "instabile_service", "p25", "p75", "p95"]
    assert all(df.count() == 0 and len(df.columns) == 14 for df in results.values())
    assert builder.visualizations == ["instabile_service", "p95"]
