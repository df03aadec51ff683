"""Sinks and many-source runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugework.operators import profile
from gaugework.plans.reports import ReportConfig
from gaugework.plans.runs import Director, overview_sources, profile_sources, report_sources
from gaugework.queries import inputs as I
from gaugework.queries.oracle import profile_ctes, profile_sql
from gaugework.queries.registry import query, rounded
from gaugework.session import shared_folder
from gaugework.sources import sinks
from gaugework.sources.metrics import METRIC, read_csv, read_sources


@query(
    "wiki_lines",
    """SELECT 0 AS part, '|| c_custkey || c_name || c_acctbal || c_mktsegment ||' AS line
    UNION ALL SELECT 1, '| ' || c_custkey || ' | ' || c_name || ' | ' || c_acctbal || ' | ' || c_mktsegment || ' |' FROM customer""",
)
def wiki_lines(spark, folder):
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    return sinks.wiki_lines(I.table(spark, folder, "customer").select(*columns))


@query(
    "wiki_missing",
    f"""WITH {I.DOCS} SELECT 0 AS part, '|| doc_id || lang || quality ||' AS line
    UNION ALL SELECT 1, '| ' || doc_id || ' | ' || lang || ' | ' || coalesce(quality::VARCHAR, 'nan') || ' |' FROM docs""",
)
def wiki_missing(spark, folder):
    return sinks.wiki_lines(I.labelled_documents(spark, folder).select("doc_id", "lang", "quality"))


SOURCES = (
    I.HOURLY
    + ", long AS ("
    + " UNION ALL ".join(
        [f"SELECT 'lines' AS source, l_shipdate AS ts, '{m}' AS metric_name, {m} AS value FROM lineitem" for m in I.LINE_METRICS]
        + [f"SELECT 'events', ts, '{e}', {e} FROM hourly" for e in I.EVENT_TYPES]
    )
    + ")"
)


def _sources(spark, folder):
    return {"lines": I.line_metrics(spark, folder), "events": I.event_metrics(spark, folder)}


@query("multi_source", profile_sql(SOURCES, "source, metric_name"))
def multi_source(spark, folder):
    return rounded(profile_sources(_sources(spark, folder)))


@query(
    "multi_source_overview",
    f"""WITH {SOURCES} SELECT source, count(DISTINCT metric_name)::INT AS total_metrics,
    count(*) // count(DISTINCT metric_name) AS total_timestamps, min(ts) AS start, max(ts) AS "end",
    floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0)::BIGINT AS time_span_days FROM long GROUP BY source""",
)
def multi_source_overview(spark, folder):
    return overview_sources(_sources(spark, folder)).select(
        "source", "total_metrics", "total_timestamps", "data_range.start", "data_range.end", "time_span_days"
    )


BY_FLAG = (
    "long AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag AS source, '{m}' AS metric_name, {m} AS value FROM lineitem" for m in I.LINE_METRICS)
    + ")"
)


def _flag_files(spark, folder):
    """The measures of lineitem as CSV folders, one per return flag."""
    path = f"{shared_folder(spark)}/flags-{uuid.uuid4().hex}"
    lines = I.table(spark, folder, "lineitem").select("l_shipdate", *I.LINE_METRICS, "l_returnflag")
    sinks.write_parts(lines, path, ["l_returnflag"])
    return {flag: f"{path}/l_returnflag={flag}" for flag in ("A", "N", "R")}


@query("multi_source_csv", profile_sql(BY_FLAG, "source, metric_name"))
def multi_source_csv(spark, folder):
    """Many CSV sources of one header, read in one scan and profiled in one job."""
    frame = read_sources(spark, _flag_files(spark, folder))
    return rounded(profile.profile(frame.long(), keys=("source", METRIC)))


@query(
    "multi_source_report",
    f"""WITH {BY_FLAG}, {profile_ctes("source, metric_name")}, found AS (
        SELECT source, 'p75' AS group_name, metric_name, p75 AS v FROM profile WHERE p75 > 1.0
        UNION ALL SELECT source, 'max_response_time', metric_name, "max" FROM profile WHERE "max" > 1.5
        UNION ALL SELECT source, 'p95', metric_name, p95 FROM profile WHERE p95 > 1.0
        UNION ALL SELECT source, 'p25', metric_name, p25 FROM profile WHERE p25 > 0.5
        UNION ALL SELECT source, 'instabile_service', metric_name, std_dev FROM profile WHERE std_dev > 0.1 AND skewness > 0.3 AND p25 > 0.5)
    SELECT source, group_name, metric_name, format('{{:.2f}}', v) AS shown FROM found""",
)
def multi_source_report(spark, folder):
    """The shipped report over many CSV sources, written as one run and read back."""
    written = report_sources(spark, _flag_files(spark, folder), f"{shared_folder(spark)}/run-{uuid.uuid4().hex}")
    rows = spark.read.options(header=True, inferSchema=False).csv(written["groups"])
    shown = F.expr("CASE group_name WHEN 'max_response_time' THEN `max` WHEN 'instabile_service' THEN std_dev WHEN 'p25' THEN p25 WHEN 'p75' THEN p75 ELSE p95 END")
    return rows.select("source", "group_name", METRIC, shown.alias("shown"))


@query(
    "run_records",
    f"""WITH {BY_FLAG}, {profile_ctes("source, metric_name")}
    SELECT source AS builder_name, true AS success, 5 AS n_reports,
        (count(*) FILTER ("max" > 1.5) + count(*) FILTER (std_dev > 0.1 AND skewness > 0.3 AND p25 > 0.5) + count(*) FILTER (p25 > 0.5)
        + count(*) FILTER (p75 > 1.0) + count(*) FILTER (p95 > 1.0))::BIGINT AS group_rows, count(*) AS profile_rows FROM profile GROUP BY source""",
)
def run_records(spark, folder):
    """A run over three CSV sources, its records, and what its sinks wrote, read back."""
    director = Director(spark, run="run")
    for flag, path in _flag_files(spark, folder).items():
        director.register(ReportConfig(path, "lines", flag, generate_visualization=False))
    records = director.process_all(f"{shared_folder(spark)}/records-{uuid.uuid4().hex}").collect()  # a row per source
    lines = []
    for r in records:
        read = lambda name, at=r["export_path"]: spark.read.csv(f"{at}/{name}.csv", header=True).count()
        groups = sum(read(f"lines_{g}") for g in r["reports_generated"])
        lines.append((r["builder_name"], r["success"], len(r["reports_generated"]), groups, read("profile_lines_metric_profiles")))
    return spark.createDataFrame(lines, "builder_name string, success boolean, n_reports int, group_rows bigint, profile_rows bigint")


@query("csv_profile", profile_sql(I.HOURLY_LONG))
def csv_profile(spark, folder):
    """The hourly metrics written as CSV, read back with inference and profiled."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(I.hourly_events(spark, folder), path)
    return rounded(profile.profile(read_csv(spark, path)))


@query(
    "csv_groups",
    f"""WITH {I.USER_LONG}, {profile_ctes()} SELECT metric_name, total_records::VARCHAR AS total_records,
    format('{{:.2f}}', "max") AS "max" FROM profile WHERE "max" > 200""",
)
def csv_groups(spark, folder):
    """A report group written with two decimals and read back as text."""
    profiles = profile.profile(I.user_metrics(spark, folder)).where(F.col("max") > 200)
    target = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"
    paths = sinks.save_groups({"max": profiles.select(METRIC, "total_records", "max")}, "user", target)
    return spark.read.option("header", True).csv(paths["max"])
