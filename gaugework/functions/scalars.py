"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spark writes a double in scientific form outside this range.
_PLAIN_LOW, _PLAIN_HIGH = 1e-3, 1e7
# Python writes a float in scientific form outside this range.
_REPR_LOW, _REPR_HIGH = 1e-4, 1e16


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(value: Column) -> Column:
    """The single missing marker of the package is NULL."""
    return F.nanvl(value, F.lit(None).cast("double"))


def present(df, column: str):
    """``df`` with NaN of a floating ``column`` as NULL."""
    floating = dict(df.dtypes)[column] in ("double", "float")
    return df.withColumn(column, nan_to_null(F.col(column))) if floating else df


def non_zero(value: Column) -> Column:
    """``value`` where it is neither missing nor zero, else NULL."""
    return F.nullif(value, F.lit(0.0))


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population ``skewness``.

    NULL below three values, 0 for a constant series (where ``g1`` is NULL).
    """
    size = n.cast("double")
    factor = F.sqrt(size * (size - 1)) / (size - 2)
    return F.when(n >= 3, F.coalesce(g1 * factor, F.lit(0.0)))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population ``kurtosis``.

    NULL below four values, 0 for a constant series (where ``g2`` is NULL).
    """
    size = n.cast("double")
    corrected = (size - 1) / ((size - 2) * (size - 3)) * ((size + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL for an empty whole."""
    return F.try_divide(part, whole) * 100


def interpret_skewness(value: Column) -> Column:
    """Wording for a skewness; a missing value reads as highly skewed."""
    size = F.abs(value)
    return (
        F.when(size < 0.5, "Fairly Symmetric")
        .when(size < 1, "Moderately Skewed")
        .otherwise("Highly Skewed")
    )


def interpret_kurtosis(value: Column) -> Column:
    """Wording for an excess kurtosis; a missing value reads as normal."""
    return (
        F.when(value < -1, "Platykurtic (Flat)")
        .when((value > 1) & ~F.isnan(value), "Leptokurtic (Peaked)")
        .otherwise("Mesokurtic (Normal)")
    )


def name_prefix(name: Column) -> Column:
    """Text before the first dot of a metric name."""
    return F.split_part(name, F.lit("."), F.lit(1))


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds, fractions kept, to a timestamp."""
    return F.timestamp_seconds(seconds)


def run_stamp(ts: Column) -> Column:
    """Timestamp as the folder name of a run."""
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def two_decimals(value: Column) -> Column:
    """Text with two decimals, NULL and NaN as NULL (a CSV writer leaves it empty).

    The exact binary value is rounded, ties to even. Below 10^13 the JVM's number format does just
    that; above, whole part and fraction of a double are exact numbers and are written apart. From
    2^93 on the shortest digits of the value are written, zeros behind them.
    """
    v = nan_to_null(value.cast("double"))
    size = F.abs(v)
    plain = lambda x: F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))
    low = F.least(size, F.lit(2.0**93))
    whole = low - F.pmod(low, F.lit(1.0))
    rest = plain(low - whole)
    high = (whole - F.pmod(whole, F.lit(2.0**40))) / 2.0**40
    digits = (
        high.cast("bigint").cast("decimal(38,0)") * F.lit(2**40).cast("decimal(13,0)")
        + F.pmod(whole, F.lit(2.0**40)).cast("bigint")
        + F.when(rest == "1.00", 1).otherwise(0)
    )
    apart = F.concat(F.when(v < 0, "-").otherwise(""), digits.cast("string"), F.substring(rest, 2, 3))
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(v < 0, "-inf").otherwise("inf"))
        .when((size < 1e13) | (size >= 2.0**93), plain(v))
        .otherwise(apart)
    )


def float_text(value: Column) -> Column:
    """A double as Python prints it: shortest digits, ``1.0``, ``1e-05``, ``1e+16``."""
    size = F.abs(value)
    text = value.cast("string")
    digits = text.cast("decimal(38,20)").cast("string")
    fixed = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(
        F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    # lpad also cuts, so three-digit powers are written whole
    exponent = F.when(
        F.abs(power) > 99,
        F.concat(F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string")),
    ).otherwise(exponent)
    return (
        F.when(value.isNull() | F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value < 0, "-inf").otherwise("inf"))
        .when((size == 0) | ((size >= _PLAIN_LOW) & (size < _PLAIN_HIGH)), text)
        .when((size >= _REPR_LOW) & (size < _REPR_HIGH), fixed)
        .otherwise(F.concat(mantissa, exponent))
    )
