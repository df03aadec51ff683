"""Histogram, density, markers, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import distribution as D
from gaugework.operators import profile
from gaugework.plans.groups import ReportBuilder
from gaugework.plans.reports import metric_report
from gaugework.plans.runs import group_readings
from gaugework.queries import inputs as I
from gaugework.queries.oracle import moments, profile_ctes, r
from gaugework.queries.registry import query, rounded


def _digits(df, **digits):
    """Named columns rounded to their digits."""
    return df.select(
        *[(F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


def _histogram_sql(source: str, extra: str = "", join: str = "") -> str:
    return f"""WITH {source}{extra}, vals AS (SELECT metric_name, value AS v FROM long {join} WHERE value <> 0),
    lim AS (SELECT metric_name, count(*) AS n, CASE WHEN min(v) = max(v) THEN min(v) - 0.5::DOUBLE ELSE min(v) END AS lo,
      CASE WHEN min(v) = max(v) THEN max(v) + 0.5::DOUBLE ELSE max(v) END AS hi FROM vals GROUP BY metric_name),
    wid AS (SELECT *, (hi - lo) / 50::DOUBLE AS width FROM lim),
    guess AS (SELECT metric_name, v, lo, width, least(floor((v - lo) / width), 49)::INT AS g FROM vals JOIN wid USING (metric_name)),
    placed AS (SELECT metric_name, CASE WHEN v < lo + g * width THEN g - 1
      WHEN v >= lo + (g + 1) * width AND g < 49 THEN g + 1 ELSE g END AS bin FROM guess),
    counted AS (SELECT metric_name, bin, count(*) AS k FROM placed GROUP BY ALL),
    spine AS (SELECT wid.*, b.bin::INT AS bin FROM wid, range(50) b(bin))
    SELECT metric_name, s.bin, {r("lo + s.bin * width", 4)} AS bin_left, {r("lo + (s.bin + 1) * width", 4)} AS bin_right,
      coalesce(k, 0) AS n_values, {r("coalesce(k, 0) / (n * width)", 9)} AS density
    FROM spine s LEFT JOIN counted USING (metric_name, bin)"""


@query("histogram", _histogram_sql(I.LINE_LONG))
def histogram(spark, folder):
    return _digits(D.histogram(I.line_metrics(spark, folder).long()), density=9, bin_left=4, bin_right=4)


@query("histogram_long", _histogram_sql(I.USER_LONG))
def histogram_long(spark, folder):
    return _digits(D.histogram(I.user_metrics(spark, folder)), density=9, bin_left=4, bin_right=4)


def _kde_sql(source: str) -> str:
    return f"""WITH {source}, vals AS (SELECT metric_name, value AS v FROM long WHERE value <> 0),
    lim AS (SELECT metric_name, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * 0.5 AS h FROM vals
      GROUP BY metric_name HAVING count(*) > 1 AND min(v) < max(v)),
    weighted AS (SELECT metric_name, v, count(*) AS w FROM vals GROUP BY ALL),
    spine AS (SELECT lim.*, p.point::INT AS point, lo + p.point * ((hi - lo) / 99) AS x FROM lim, range(100) p(point)),
    sums AS (SELECT s.metric_name, point, any_value(x) AS x, any_value(n) AS n, any_value(h) AS h,
      sum(w * exp(-0.5::DOUBLE * ((s.x - v) / h) * ((s.x - v) / h))) AS k
      FROM weighted JOIN spine s USING (metric_name) GROUP BY s.metric_name, point)
    SELECT metric_name, point, {r("x", 4)} AS x, {r("k / (n * h * sqrt(2 * pi()))", 9)} AS density FROM sums"""


@query("kde", _kde_sql(I.SUPPLIER_LONG))
def kde(spark, folder):
    return _digits(D.kde(I.supplier_metrics(spark, folder)), x=4, density=9)


@query("kde_wide", _kde_sql(I.LINE_LONG))
def kde_wide(spark, folder):
    return _digits(D.kde(I.line_metrics(spark, folder).long()), x=4, density=9)


@query(
    "markers",
    f"""WITH {I.LINE_LONG} SELECT metric_name, {r("quantile_cont(nullif(value, 0.0), 0.5)")} AS median,
    {r("quantile_cont(nullif(value, 0.0), 0.75)")} AS p75 FROM long GROUP BY metric_name""",
)
def markers(spark, folder):
    return rounded(D.markers(I.line_metrics(spark, folder).long()))


@query(
    "shape_with_zeros",
    f"""WITH {I.LINE_LONG}, xs AS (SELECT metric_name, value AS x FROM long), {moments("metric_name", "xs", "shape")}
    SELECT metric_name, {r("skewness")} AS skewness, {r("kurtosis")} AS kurtosis FROM shape""",
)
def shape_with_zeros(spark, folder):
    return rounded(D.shape_with_zeros(I.line_metrics(spark, folder).long()))


@query(
    "box_stats",
    f"""WITH {I.VECTORS}, long AS (
      {" UNION ALL ".join(f"SELECT cluster, '{f}' AS feature, {f} AS value FROM vectors" for f in I.FEATURES[:3])}),
    q AS (SELECT cluster, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL),
    near AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM long JOIN q USING (cluster, feature))
    SELECT cluster, feature, {r("q1")} AS q1, {r("median")} AS median, {r("q3")} AS q3,
      {r("min(value) FILTER (WHERE ok)")} AS whisker_low, {r("max(value) FILTER (WHERE ok)")} AS whisker_high,
      count(*) FILTER (WHERE NOT ok) AS n_outside FROM near GROUP BY cluster, feature, near.q1, near.median, near.q3""",
)
def box_stats(spark, folder):
    return rounded(D.box_stats(I.vectors(spark, folder), I.FEATURES[:3]))


@query(
    "melt",
    f"WITH {I.VECTORS} "
    + " UNION ALL ".join(f"SELECT cluster, '{f}' AS feature, {r(f)} AS value FROM vectors" for f in I.FEATURES[:3]),
)
def melt(spark, folder):
    return rounded(D.melt(I.vectors(spark, folder), ["cluster"], I.FEATURES[:3]))


FLAGGED = "SELECT metric_name FROM profile WHERE p95 > 1.0"


@query(
    "group_distribution",
    _histogram_sql(I.LINE_LONG, ", " + profile_ctes(), f"SEMI JOIN ({FLAGGED}) f USING (metric_name)"),
)
def group_distribution(spark, folder):
    """Histogram of the metrics in the flagged p95 group."""
    lines = I.line_metrics(spark, folder)
    builder = metric_report(ReportBuilder(profile.profile(lines)))
    readings = group_readings(lines.long(), builder.build_single("p95"))
    return _digits(D.histogram(readings), density=9, bin_left=4, bin_right=4)
