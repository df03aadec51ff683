"""Input frames of the registered queries, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.sources.metrics import MetricFrame, from_table

LINE_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
DIMENSIONS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_metrics(spark: SparkSession, folder: str) -> MetricFrame:
    """Wide metrics with zeros: the measures of lineitem over the ship date."""
    return from_table(table(spark, folder, "lineitem"), "l_shipdate", LINE_METRICS)


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Wide metrics with gaps: hourly value sums per event type."""
    events = table(spark, folder, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "value"
    )
    wide = events.groupBy("ts").pivot("event_type", EVENT_TYPES).agg(F.sum("value"))
    return wide.select("ts", *[F.round(e, 2).alias(e) for e in EVENT_TYPES])


def event_metrics(spark: SparkSession, folder: str) -> MetricFrame:
    return from_table(hourly_events(spark, folder))


def user_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Long metrics, one per event type and user, with dotted names."""
    name = F.concat_ws(".", "event_type", F.col("user_id").cast("string"))
    return table(spark, folder, "events").select("ts", name.alias("metric_name"), "value")


def supplier_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Long metrics, the discounts of each supplier, with zeros."""
    name = F.concat(F.lit("supp."), F.col("l_suppkey").cast("string"))
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").alias("ts"), name.alias("metric_name"), F.col("l_discount").alias("value")
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most labels are missing."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as a key and one column per dimension, with their label."""
    cells = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMENSIONS)]
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("cluster"), *cells)


FEATURES = [f"f{i}" for i in range(DIMENSIONS)]

LINE_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT l_shipdate AS ts, '{m}' AS metric_name, {m} AS value FROM lineitem" for m in LINE_METRICS
) + ")"

HOURLY = (
    "hourly AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, "
    + ", ".join(f"round(sum(CASE WHEN event_type = '{e}' THEN value END), 2) AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY 1)"
)

HOURLY_LONG = HOURLY + ", long AS (" + " UNION ALL ".join(
    f"SELECT ts, '{e}' AS metric_name, {e} AS value FROM hourly" for e in EVENT_TYPES
) + ")"

USER_LONG = "long AS (SELECT ts, event_type || '.' || user_id AS metric_name, value FROM events)"

SUPPLIER_LONG = (
    "long AS (SELECT l_shipdate AS ts, 'supp.' || l_suppkey AS metric_name, l_discount AS value FROM lineitem)"
)

DOCS = (
    "docs AS (SELECT d.doc_id, lang, source, n_chars, text, quality, toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)

VECTORS = (
    "vectors AS (SELECT vec_id, label AS cluster, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(DIMENSIONS))
    + " FROM embeddings)"
)
