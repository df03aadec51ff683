"""SQL texts the comparison engine runs beside the queries."""

from __future__ import annotations

from collections.abc import Sequence

from gaugework.operators.profile import PROFILE_FIELDS

QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
COUNTS = {"null_count", "non_zero_records", "zero_count", "total_records"}


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def moments(keys: str, source: str, out: str) -> str:
    """CTEs with count, mean, deviation and bias-corrected shape of ``x`` per key."""
    return f"""
{out}_a AS (SELECT {keys}, count(x) AS n, avg(x) AS mean, min(x) AS lo, max(x) AS hi FROM {source} GROUP BY {keys}),
{out}_b AS (SELECT {keys}, n, mean, lo, hi, sum(pow(x - mean, 2)) AS m2, sum(pow(x - mean, 3)) AS m3,
  sum(pow(x - mean, 4)) AS m4 FROM {source} JOIN {out}_a USING ({keys}) WHERE x IS NOT NULL
  GROUP BY {keys}, n, mean, lo, hi),
{out} AS (SELECT {keys}, n, mean, lo, hi, CASE WHEN n > 1 THEN CASE WHEN lo = hi THEN 0.0 ELSE sqrt(m2 / (n - 1)) END END AS sd,
  CASE WHEN n < 3 THEN NULL WHEN lo = hi THEN 0.0
    ELSE n * sqrt(n - 1.0) / (n - 2) * m3 / pow(m2, 1.5) END AS skewness,
  CASE WHEN n < 4 THEN NULL WHEN lo = hi THEN 0.0
    ELSE n * (n + 1.0) * (n - 1) * m4 / ((n - 2.0) * (n - 3) * m2 * m2) - 3.0 * (n - 1) * (n - 1) / ((n - 2.0) * (n - 3))
  END AS kurtosis FROM {out}_b)"""


def profile_ctes(keys: str = "metric_name") -> str:
    """CTE ``profile`` (unrounded) from a CTE ``long`` with ``keys`` and ``value``."""
    quantiles = ", ".join(f"quantile_cont(x, {p}) AS {name}" for name, p in QUANTILES.items())
    return f"""
xs AS (SELECT {keys}, nullif(value, 0.0) AS x, value FROM long),
{moments(keys, "xs", "shape")},
counts AS (SELECT {keys}, count(*) AS all_rows, count(value) AS total_records, {quantiles} FROM xs GROUP BY {keys}),
profile AS (SELECT {keys}, mean, median, sd AS std_dev, skewness, kurtosis, lo AS "min", hi AS "max", p05, p25, p75, p95,
  p75 - p25 AS iqr, all_rows - total_records AS null_count,
  (all_rows - total_records)::DOUBLE / all_rows * 100 AS null_percentage, n AS non_zero_records,
  total_records - n AS zero_count, (total_records - n)::DOUBLE / total_records * 100 AS zero_percentage, total_records
  FROM counts JOIN shape USING ({keys}) WHERE n > 0)"""


def profile_fields(names: Sequence[str] = PROFILE_FIELDS, digits: int = 6) -> str:
    """The select list of rounded profile fields."""
    fields = []
    for name in names:
        plain = name in COUNTS or name == "metric_name"
        fields.append(name if plain else f'{r(f"{chr(34)}{name}{chr(34)}", digits)} AS "{name}"')
    return ", ".join(fields)


def profile_sql(source: str, keys: str = "metric_name", extra: str = "") -> str:
    others = "".join(f"{k.strip()}, " for k in keys.split(",") if k.strip() != "metric_name")
    return f"WITH {source}, {profile_ctes(keys)} SELECT {others}{profile_fields()} FROM profile {extra}"
