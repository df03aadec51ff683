"""Groups, their combinations, summaries and the shipped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import profile
from gaugework.plans.groups import ReportBuilder, from_constraints
from gaugework.plans.reports import REPORT_COLUMNS, Thresholds, metric_report
from gaugework.queries import inputs as I
from gaugework.queries.oracle import profile_ctes, profile_fields, r
from gaugework.queries.registry import query, rounded

PARTS = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]


def _parts(spark, folder):
    return ReportBuilder(I.table(spark, folder, "part"), tie_key="p_partkey")


def _part_groups(spark, folder):
    builder = _parts(spark, folder)
    builder.create_filter_group("cheap_small", "Small parts at a low price")
    builder.add_column_filter("p_size", "<=", 10).add_column_filter("p_retailprice", "<", 950)
    builder.create_filter_group("promo", "Promoted parts")
    builder.add_column_filter("p_type", "==", "PROMO").set_sorting(["p_retailprice"], ascending=False)
    builder.create_filter_group("top_sizes", "The largest economy parts")
    builder.add_column_filter("p_type", "in", ["ECONOMY", "LARGE"]).add_range_filter("p_size", min_val=20)
    builder.add_sort_column("p_size", ascending=False).add_sort_column("p_retailprice")
    builder.select_columns(PARTS).limit_rows(25)
    return builder


CHEAP = "(p_size <= 10 AND p_retailprice < 950)"
PROMO = "p_type = 'PROMO'"
TOP = "(p_type IN ('ECONOMY', 'LARGE') AND p_size >= 20)"


@query(
    "group_transform",
    "SELECT p_partkey, round(p_retailprice / p_size, 4) AS unit_price FROM part WHERE round(p_retailprice / p_size, 4) > 100",
)
def group_transform(spark, folder):
    builder = _parts(spark, folder).create_filter_group("unit")
    builder.add_transformation(
        lambda df: df.withColumn("unit_price", F.round(F.try_divide("p_retailprice", "p_size"), 4))
    )
    return builder.add_column_filter("unit_price", ">", 100).select_columns(["p_partkey", "unit_price"]).build_single()


@query("group_select", f"SELECT p_brand, p_size FROM part WHERE {CHEAP}")
def group_select(spark, folder):
    builder = _part_groups(spark, folder).switch_group("cheap_small")
    return builder.select_columns(["p_brand", "p_size"]).build_single()


@query("group_sort", f"SELECT * FROM part WHERE {PROMO} ORDER BY p_retailprice DESC")
def group_sort(spark, folder):
    return _part_groups(spark, folder).build_single("promo")


@query(
    "group_multi_sort",
    f"SELECT p_partkey, p_size, p_retailprice FROM part WHERE {TOP} ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 100",
)
def group_multi_sort(spark, folder):
    builder = _part_groups(spark, folder).switch_group("top_sizes")
    return builder.select_columns(["p_partkey", "p_size", "p_retailprice"]).limit_rows(100).build_single()


@query(
    "group_limit",
    f"SELECT {', '.join(PARTS)} FROM part WHERE {TOP} ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 25",
)
def group_limit(spark, folder):
    return _part_groups(spark, folder).build_all()["top_sizes"]


@query(
    "group_nulls_last",
    f"WITH {I.DOCS} SELECT doc_id, quality FROM docs ORDER BY quality DESC NULLS LAST, doc_id LIMIT 300",
)
def group_nulls_last(spark, folder):
    builder = ReportBuilder(I.labelled_documents(spark, folder), tie_key="doc_id").create_filter_group("all")
    builder.set_sorting(["quality"], ascending=False).select_columns(["doc_id", "quality"])
    return builder.limit_rows(300).build_single()


@query(
    "group_nulls_last_ascending",
    f"WITH {I.DOCS} SELECT doc_id, quality FROM docs WHERE doc_id % 5 < 3 ORDER BY quality NULLS LAST, doc_id LIMIT 350",
)
def group_nulls_last_ascending(spark, folder):
    docs = I.labelled_documents(spark, folder)
    builder = ReportBuilder(docs, tie_key="doc_id").create_filter_group("some").add_filter(F.col("doc_id") % 5 < 3)
    return builder.set_sorting(["quality"]).select_columns(["doc_id", "quality"]).limit_rows(350).build_single()


@query(
    "group_all_tagged",
    " UNION ALL ".join(
        f"SELECT '{n}' AS group_name, * FROM part WHERE {w}"
        for n, w in (("cheap_small", CHEAP), ("promo", PROMO), ("top_sizes", TOP))
    ),
)
def group_all_tagged(spark, folder):
    return _part_groups(spark, folder).build_tagged()


@query(
    "group_all_limited",
    f"""WITH top AS (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey)::INT AS place FROM part WHERE {TOP}),
    promo AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS place FROM part WHERE {PROMO})
    SELECT 'cheap_small' AS group_name, NULL::INT AS place, * FROM part WHERE {CHEAP}
    UNION ALL SELECT 'promo', place, * EXCLUDE (place) FROM promo WHERE place <= 40
    UNION ALL SELECT 'top_sizes', place, * EXCLUDE (place) REPLACE (NULL AS p_name) FROM top WHERE place <= 25""",
)
def group_all_limited(spark, folder):
    """All groups with sorting, selection and limits from one scan."""
    builder = _part_groups(spark, folder).switch_group("promo").limit_rows(40)
    return builder.build_results()


@query(
    "group_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS group_name, least(count(*), {most}) AS n_rows FROM part WHERE {w}"
        for n, w, most in (("cheap_small", CHEAP, "count(*)"), ("promo", PROMO, "count(*)"), ("top_sizes", TOP, 25))
    ),
)
def group_counts(spark, folder):
    return _part_groups(spark, folder).group_counts()


@query("group_intersection", f"SELECT * FROM part WHERE {CHEAP} AND {PROMO}")
def group_intersection(spark, folder):
    return _part_groups(spark, folder).build_combined(["cheap_small", "promo"], "intersection")


@query("group_union", f"SELECT * FROM part WHERE {CHEAP} OR {PROMO}")
def group_union(spark, folder):
    return _part_groups(spark, folder).build_combined(["cheap_small", "promo"], "union")


def _summary_line(name, text, filters, sort, ascending, columns, limit, where):
    passed = f"count(*) FILTER (WHERE {where})"
    kept = f"least({passed}, {limit})" if limit else passed
    return (
        f"SELECT '{name}' AS group_name, '{text}' AS description, {filters} AS filter_count, {sort} AS sort_columns, "
        f"{ascending} AS sort_ascending, '{columns}' AS selected_columns, '{limit or 'No limit'}' AS row_limit, "
        f"0 AS transformations_count, count(*) AS original_rows, {kept} AS filtered_rows, "
        f"round({kept}::DOUBLE / count(*) * 100, 2) AS remaining_percentage FROM part"
    )


@query(
    "group_summary",
    " UNION ALL ".join(
        [
            _summary_line("cheap_small", "Small parts at a low price", 2, "'[]'", "true", "All", 0, CHEAP),
            _summary_line("promo", "Promoted parts", 1, "'[''p_retailprice'']'", "false", "All", 0, PROMO),
            _summary_line(
                "top_sizes", "The largest economy parts", 2,
                "'[(''p_size'', False), (''p_retailprice'', True)]'", "true", "5", 25, TOP,
            ),
        ]
    ),
)
def group_summary(spark, folder):
    return _part_groups(spark, folder).get_summary_report()


CONSTRAINTS = [
    {"group": "user_defined_1", "column": "p_retailprice", "op": ">", "value": 1000},
    {"group": "user_defined_1", "column": "p_type", "op": "in", "value": ["SMALL", "MEDIUM"]},
    {"group": "user_defined_2", "column": "p_brand", "op": "==", "value": "Brand#2"},
    {"group": "user_defined_2", "column": "p_size", "op": ">", "value": 25},
]


@query(
    "group_dynamic",
    """SELECT 'user_defined_1' AS group_name, * FROM part WHERE p_type IN ('SMALL', 'MEDIUM')
    UNION ALL SELECT 'user_defined_2', * FROM part WHERE p_size > 25""",
)
def group_dynamic(spark, folder):
    """A repeated group name starts over, so the last constraint of a group counts."""
    return from_constraints(I.table(spark, folder, "part"), CONSTRAINTS).build_tagged()


@query(
    "group_dynamic_all",
    """SELECT 'user_defined_1' AS group_name, * FROM part WHERE p_retailprice > 1000 AND p_type IN ('SMALL', 'MEDIUM')
    UNION ALL SELECT 'user_defined_2', * FROM part WHERE p_brand = 'Brand#2' AND p_size > 25""",
)
def group_dynamic_all(spark, folder):
    return from_constraints(I.table(spark, folder, "part"), CONSTRAINTS, reset=False).build_tagged()


# -- shipped reports --------------------------------------------------------------

# The shipped thresholds suit response times in seconds; event values are larger.
LIMITS = Thresholds(max=200.0, std_dev=30.0, skewness=1.0, stable_p25=14.0, p25=16.0, p75=70.0, p95=150.0)

REPORTS = {
    "max_response_time": f'"max" > {LIMITS.max}',
    "instabile_service": f"std_dev > {LIMITS.std_dev} AND skewness > {LIMITS.skewness} AND p25 > {LIMITS.stable_p25}",
    "p25": f"p25 > {LIMITS.p25}",
    "p75": f"p75 > {LIMITS.p75}",
    "p95": f"p95 > {LIMITS.p95}",
}


def _report_sql(where: str) -> str:
    return f"WITH {I.USER_LONG}, {profile_ctes()} SELECT {profile_fields(REPORT_COLUMNS)} FROM profile WHERE {where}"


def user_report(spark, folder) -> ReportBuilder:
    profiles = profile.profile(I.user_metrics(spark, folder))
    return metric_report(ReportBuilder(profiles), LIMITS)


def _register(name: str, group: str):
    @query(name, _report_sql(REPORTS[group]))
    def run(spark, folder):
        return rounded(user_report(spark, folder).build_single(group))

    return run


_register("report_max", "max_response_time")
_register("report_unstable", "instabile_service")
_register("report_p25", "p25")
_register("report_p75", "p75")
_register("report_p95", "p95")


@query(
    "report_default_limits",
    f"""WITH {I.LINE_LONG}, {profile_ctes()} SELECT 'p75' AS group_name, {profile_fields()} FROM profile WHERE p75 > 1.0
    UNION ALL SELECT 'max_response_time', {profile_fields()} FROM profile WHERE "max" > 1.5
    UNION ALL SELECT 'p95', {profile_fields()} FROM profile WHERE p95 > 1.0
    UNION ALL SELECT 'p25', {profile_fields()} FROM profile WHERE p25 > 0.5
    UNION ALL SELECT 'instabile_service', {profile_fields()} FROM profile WHERE std_dev > 0.1 AND skewness > 0.3 AND p25 > 0.5""",
)
def report_default_limits(spark, folder):
    profiles = profile.profile(I.line_metrics(spark, folder))
    return rounded(metric_report(ReportBuilder(profiles)).build_tagged())


@query(
    "affected_categories",
    f"WITH {I.USER_LONG}, {profile_ctes()} "
    + " UNION ".join(
        f"SELECT '{g}' AS group_name, split_part(metric_name, '.', 1) AS category FROM profile WHERE {w}"
        for g, w in REPORTS.items()
    ),
)
def affected_categories(spark, folder):
    return user_report(spark, folder).affected_categories()


@query(
    "top_zero",
    f"""WITH {I.SUPPLIER_LONG}, {profile_ctes()} SELECT metric_name, {r("zero_percentage")} AS zero_percentage,
    zero_count, total_records FROM profile ORDER BY profile.zero_percentage DESC, metric_name LIMIT 5""",
)
def top_zero(spark, folder):
    return rounded(profile.top_zero(profile.profile(I.supplier_metrics(spark, folder))))
