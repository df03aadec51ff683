"""One query per predicate of the report builder."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.plans.groups import ReportBuilder
from gaugework.queries import inputs as I
from gaugework.queries.registry import query

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
DOC_COLUMNS = ["doc_id", "lang", "n_chars", "quality"]


def _orders(where: str) -> str:
    return f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE {where}"


def _docs(where: str) -> str:
    return f"WITH {I.DOCS} SELECT {', '.join(DOC_COLUMNS)} FROM docs WHERE {where}"


def _register(name, source, columns, sql, *condition):
    @query(name, sql)
    def run(spark, folder):
        builder = ReportBuilder(source(spark, folder)).create_filter_group(name)
        return builder.add_column_filter(*condition).select_columns(columns).build_single()

    return run


def orders(spark, folder):
    return I.table(spark, folder, "orders")


_register("filter_eq", orders, ORDER_COLUMNS, _orders("o_orderstatus = 'F'"), "o_orderstatus", "==", "F")
_register("filter_ne", I.labelled_documents, DOC_COLUMNS, _docs("quality IS DISTINCT FROM 1"), "quality", "!=", 1)
_register("filter_gt", orders, ORDER_COLUMNS, _orders("o_totalprice > 400000"), "o_totalprice", ">", 400000)
_register("filter_lt", orders, ORDER_COLUMNS, _orders("o_totalprice < 50000"), "o_totalprice", "<", 50000)
_register("filter_ge", I.labelled_documents, DOC_COLUMNS, _docs("quality >= 1"), "quality", ">=", 1)
_register("filter_le", I.labelled_documents, DOC_COLUMNS, _docs("quality <= 0"), "quality", "<=", 0)
_register(
    "filter_in", orders, ORDER_COLUMNS, _orders("o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "o_orderpriority", "in", ["1-URGENT", "5-LOW"],
)
_register(
    "filter_in_missing", I.labelled_documents, DOC_COLUMNS, _docs("quality = 1 OR quality IS NULL"),
    "quality", "in", [1, None],
)
_register(
    "filter_not_in", I.labelled_documents, DOC_COLUMNS, _docs("NOT coalesce(quality IN (0), false)"),
    "quality", "not in", [0],
)
_register(
    "filter_contains", I.labelled_documents, DOC_COLUMNS, _docs("regexp_matches(text, '[0-9]{3}-[0-9]{4}')"),
    "text", "contains", "[0-9]{3}-[0-9]{4}",
)
_register(
    "filter_startswith", I.labelled_documents, DOC_COLUMNS, _docs("starts_with(source, 'src1')"),
    "source", "startswith", "src1",
)
_register(
    "filter_endswith", I.labelled_documents, DOC_COLUMNS, _docs("ends_with(text, '.')"), "text", "endswith", ".",
)
_register("filter_isna", I.labelled_documents, DOC_COLUMNS, _docs("quality IS NULL"), "quality", "isna")
_register("filter_notna", I.labelled_documents, DOC_COLUMNS, _docs("quality IS NOT NULL"), "quality", "notna")


@query("filter_range", _orders("o_totalprice >= 100000 AND o_totalprice <= 150000"))
def filter_range(spark, folder):
    builder = ReportBuilder(orders(spark, folder)).create_filter_group("range")
    builder.add_range_filter("o_totalprice", min_val=100000, max_val=150000)
    return builder.select_columns(ORDER_COLUMNS).build_single()


@query("filter_range_open", _docs("quality >= 1"))
def filter_range_open(spark, folder):
    builder = ReportBuilder(I.labelled_documents(spark, folder)).create_filter_group("range")
    return builder.add_range_filter("quality", min_val=1).select_columns(DOC_COLUMNS).build_single()


@query("filter_callable", _orders("o_totalprice > 300000 AND length(o_orderpriority) > 6 AND o_orderstatus <> 'P'"))
def filter_callable(spark, folder):
    builder = ReportBuilder(orders(spark, folder)).create_filter_group("own")
    builder.add_filter(lambda df: df["o_totalprice"] > 300000)
    builder.add_filter(F.length("o_orderpriority") > 6)
    builder.add_filter("o_orderstatus <> 'P'")
    return builder.select_columns(ORDER_COLUMNS).build_single()


@query("filter_multiple", _orders("o_totalprice > 250000 AND o_orderstatus = 'O'"))
def filter_multiple(spark, folder):
    builder = ReportBuilder(orders(spark, folder)).create_filter_group("many")
    builder.add_multiple_filters([lambda df: df["o_totalprice"] > 250000, F.col("o_orderstatus") == "O"])
    return builder.select_columns(ORDER_COLUMNS).build_single()
