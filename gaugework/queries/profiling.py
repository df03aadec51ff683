"""Profiles, overview, summary, correlation, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import scalars
from gaugework.operators import correlation, profile, sketches
from gaugework.queries import inputs as I
from gaugework.queries.oracle import profile_ctes, profile_fields, profile_sql, r
from gaugework.queries.registry import query, rounded
from gaugework.session import stored
from gaugework.sources.metrics import MetricFrame, from_table, shape


@query("profile_wide", profile_sql(I.LINE_LONG))
def profile_wide(spark, folder):
    return rounded(profile.profile(I.line_metrics(spark, folder)))


@query("profile_nulls", profile_sql(I.HOURLY_LONG))
def profile_nulls(spark, folder):
    return rounded(profile.profile(I.event_metrics(spark, folder)))


@query("profile_long", profile_sql(I.USER_LONG))
def profile_long(spark, folder):
    return rounded(profile.profile(I.user_metrics(spark, folder)))


@query("profile_zeros", profile_sql(I.SUPPLIER_LONG))
def profile_zeros(spark, folder):
    return rounded(profile.profile(I.supplier_metrics(spark, folder)))


@query("profile_single", profile_sql(I.LINE_LONG, extra="WHERE metric_name = 'l_discount'"))
def profile_single(spark, folder):
    return rounded(profile.metric_profile(I.line_metrics(spark, folder), "l_discount"))


@query("profile_approx")
def profile_approx(spark, folder):
    return rounded(profile.profile(I.line_metrics(spark, folder), quantile_mode="approx"))


EXACT = ["mean", "std_dev", "skewness", "kurtosis", "min", "max", "null_count", "non_zero_records", "zero_count", "total_records"]


@query(
    "profile_merged",
    f"""WITH {I.USER_LONG}, {profile_ctes()} SELECT {profile_fields(["metric_name", *EXACT])}, true AS within FROM profile""",
)
def profile_merged(spark, folder):
    """Profiles added up from the stored states of days; percentiles are held against their ranks."""
    long = I.user_metrics(spark, folder)
    days = stored(sketches.metric_states(long.withColumn("day", F.to_date("ts")), parts=["day"]))
    profiles = sketches.profile_of_states(sketches.merged_states(days)).persist()
    errors = sketches.rank_errors(long, profiles)
    worst = F.greatest(*[F.col(f) for f in ("p05", "p25", "median", "p75", "p95")])
    # a sketch of few values holds them all, yet a rank between two values may fall to either
    allowed = sketches.RANK_ERROR + F.lit(1.0) / F.col("non_zero_records")
    return rounded(profiles.select("metric_name", *EXACT).join(errors.select("metric_name", worst.alias("worst")), "metric_name").select(
        "metric_name", *EXACT, (F.col("worst") <= allowed).alias("within")
    ))


@query(
    "profile_approx_error",
    f"""WITH {I.LINE_LONG}, {profile_ctes()} SELECT metric_name, true AS within FROM profile""",
)
def profile_approx_error(spark, folder):
    """Whether the percentiles of the single-scan profile are within the error of their ranks."""
    frame = I.line_metrics(spark, folder)
    errors = sketches.rank_errors(frame.long(), profile.profile(frame, quantile_mode="approx"))
    worst = F.greatest(*[F.col(f) for f in ("p05", "p25", "median", "p75", "p95")])
    return errors.select("metric_name", (worst <= sketches.RANK_ERROR).alias("within"))


def _overview_sql(source: str, ts: str, metrics: int) -> str:
    return (
        f"SELECT {metrics} AS total_metrics, count(*) AS total_timestamps, min({ts}) AS start, max({ts}) AS \"end\", "
        f"floor((epoch_us(max({ts})) - epoch_us(min({ts}))) / 86400000000.0)::BIGINT AS time_span_days FROM {source}"
    )


def _flat(df):
    return df.select(
        "total_metrics", "total_timestamps", "data_range.start", "data_range.end", "time_span_days"
    )


@query("overview", _overview_sql("lineitem", "l_shipdate", len(I.LINE_METRICS)))
def overview(spark, folder):
    return _flat(profile.overview(I.line_metrics(spark, folder)))


@query("overview_hourly", f"WITH {I.HOURLY} " + _overview_sql("hourly", "ts", len(I.EVENT_TYPES)))
def overview_hourly(spark, folder):
    return _flat(profile.overview(I.event_metrics(spark, folder)))


@query(
    "profile_summary",
    f"""WITH {I.HOURLY_LONG}, {profile_ctes()} SELECT count(*) AS total_metrics_analyzed,
    count(*) FILTER (WHERE zero_count > 0) AS metrics_with_zeros, {r("avg(zero_percentage)")} AS avg_zero_percentage,
    {r("avg(null_percentage)")} AS avg_null_percentage FROM profile""",
)
def profile_summary(spark, folder):
    return rounded(profile.summary(profile.profile(I.event_metrics(spark, folder))))


@query(
    "null_counts",
    f"WITH {I.HOURLY} "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM hourly" for c in ["ts", *I.EVENT_TYPES]),
)
def null_counts(spark, folder):
    return profile.null_counts(I.hourly_events(spark, folder))


@query(
    "describe",
    f"""WITH {I.LINE_LONG} SELECT metric_name AS feature, count(value) AS n, {r("avg(value)")} AS mean,
    {r("stddev_samp(value)")} AS std, min(value) AS "min", {r("quantile_cont(value, 0.25)")} AS p25,
    {r("quantile_cont(value, 0.5)")} AS p50, {r("quantile_cont(value, 0.75)")} AS p75, max(value) AS "max"
    FROM long GROUP BY metric_name""",
)
def describe(spark, folder):
    return rounded(profile.describe(I.table(spark, folder, "lineitem"), I.LINE_METRICS))


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def table_shape(spark, folder):
    return shape(I.table(spark, folder, "lineitem"))


@query(
    "metric_discovery",
    """SELECT m.metric_name, count(*) AS n_rows FROM part,
    (VALUES ('p_size'), ('p_retailprice')) m(metric_name) GROUP BY m.metric_name""",
)
def metric_discovery(spark, folder):
    """Numeric columns of a table, first column as the axis."""
    frame = from_table(I.table(spark, folder, "part").withColumn("p_partkey", F.col("p_partkey").cast("double")))
    return frame.long().groupBy("metric_name").agg(F.count("*").alias("n_rows"))


def _corr(a: str, b: str) -> str:
    return r(f"nullif(corr(nullif({a}, 0.0), nullif({b}, 0.0)), 'nan'::DOUBLE)")


def _correlation_long(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {_corr(a, b)} AS corr FROM {source}" for a in names for b in names
    )


@query("correlation_long", _correlation_long("lineitem", I.LINE_METRICS))
def correlation_long(spark, folder):
    return rounded(correlation.correlation(I.line_metrics(spark, folder)))


@query("correlation_nulls", f"WITH {I.HOURLY} " + _correlation_long("hourly", I.EVENT_TYPES))
def correlation_nulls(spark, folder):
    return rounded(correlation.correlation(I.event_metrics(spark, folder)))


@query(
    "correlation_wide",
    " UNION ALL ".join(
        f"SELECT '{a}' AS metric_name, " + ", ".join(f"{_corr(a, b)} AS {b}" for b in I.LINE_METRICS) + " FROM lineitem"
        for a in I.LINE_METRICS
    ),
)
def correlation_wide(spark, folder):
    return rounded(correlation.correlation_wide(I.line_metrics(spark, folder)))


@query(
    "correlation_many",
    f"""WITH {I.VECTORS}, cells AS (
        SELECT vec_id, metric, nullif(v, 0)::DOUBLE AS v FROM (UNPIVOT vectors ON {", ".join(I.FEATURES)} INTO NAME metric VALUE v)
    )
    SELECT x.metric AS metric_a, y.metric AS metric_b, {_corr("x.v", "y.v")} AS corr
    FROM cells x JOIN cells y USING (vec_id) GROUP BY ALL""",
)
def correlation_many(spark, folder):
    """All components of the vectors."""
    df = I.vectors(spark, folder)
    frame = MetricFrame(df.select("vec_id", *I.FEATURES), "vec_id", tuple(I.FEATURES))
    return rounded(correlation.correlation(frame))


@query(
    "interpret_shape",
    f"""WITH {I.USER_LONG}, {profile_ctes()} SELECT metric_name,
    CASE WHEN abs(skewness) < 0.5 THEN 'Fairly Symmetric' WHEN abs(skewness) < 1 THEN 'Moderately Skewed'
      ELSE 'Highly Skewed' END AS skewness_text,
    CASE WHEN kurtosis < -1 THEN 'Platykurtic (Flat)' WHEN kurtosis > 1 THEN 'Leptokurtic (Peaked)'
      ELSE 'Mesokurtic (Normal)' END AS kurtosis_text FROM profile""",
)
def interpret_shape(spark, folder):
    profiles = profile.profile(I.user_metrics(spark, folder))
    return profiles.select(
        "metric_name",
        scalars.interpret_skewness(F.col("skewness")).alias("skewness_text"),
        scalars.interpret_kurtosis(F.col("kurtosis")).alias("kurtosis_text"),
    )


@query(
    "epoch_to_ts",
    "SELECT event_id, make_timestamp(1704067200000000 + event_id * 250000) AS ts FROM events",
)
def epoch_to_ts(spark, folder):
    """Epoch seconds with fractions, made from the event numbers, to timestamps."""
    seconds = F.col("event_id") * 0.25 + 1704067200
    events = I.table(spark, folder, "events").select("event_id", seconds.alias("epoch"))
    frame = from_table(events.select("epoch", "event_id"), "epoch", ["event_id"])
    in_utc = F.to_utc_timestamp(F.col("epoch"), F.current_timezone())
    return frame.df.select(F.col("event_id").cast("bigint").alias("event_id"), in_utc.cast("timestamp_ntz").alias("ts"))


@query("run_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS run FROM events")
def run_stamp(spark, folder):
    return I.table(spark, folder, "events").select("event_id", scalars.run_stamp(F.col("ts")).alias("run"))


@query("name_prefix", f"WITH {I.USER_LONG} SELECT split_part(metric_name, '.', 1) AS category, count(*) AS n_rows FROM long GROUP BY 1")
def name_prefix(spark, folder):
    names = I.user_metrics(spark, folder).select(scalars.name_prefix(F.col("metric_name")).alias("category"))
    return names.groupBy("category").agg(F.count("*").alias("n_rows"))


@query(
    "two_decimals",
    "SELECT o_orderkey, format('{:.2f}', o_totalprice) AS price FROM orders",
)
def two_decimals(spark, folder):
    return I.table(spark, folder, "orders").select(
        "o_orderkey", scalars.two_decimals(F.col("o_totalprice")).alias("price")
    )


@query(
    "zero_to_missing",
    "SELECT count(*) AS n_rows, count(nullif(l_discount, 0.0)) AS n_discount, count(nullif(l_tax, 0.0)) AS n_tax FROM lineitem",
)
def zero_to_missing(spark, folder):
    lines = I.line_metrics(spark, folder).df
    return lines.agg(
        F.count("*").alias("n_rows"),
        F.count(scalars.non_zero(F.col("l_discount"))).alias("n_discount"),
        F.count(scalars.non_zero(F.col("l_tax"))).alias("n_tax"),
    )
