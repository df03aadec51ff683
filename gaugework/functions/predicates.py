"""Column predicates of the report builder.

Missing (NULL or NaN) cells fail every comparison, but pass "!=" and "not in".
Comparisons stay plain so that they reach the scan; a NaN guard is added beside
them only on floating-point columns.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugework.functions.scalars import quoted

Condition = Callable[[DataFrame], Column]

TEXT_OPERATORS = ("contains", "startswith", "endswith")
OPERATORS = (
    "==", "!=", ">", "<", ">=", "<=", "in", "not in", *TEXT_OPERATORS, "isna", "notna",
)


def is_missing(value: Any) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value))


def column_condition(column: str, operator: str, value: Any = None) -> Condition:
    """The predicate ``column operator value``; a bad operator fails here."""
    if operator not in OPERATORS:
        raise ValueError(f"no filter operator {operator!r}; there are {', '.join(OPERATORS)}")

    def condition(df: DataFrame) -> Column:
        return _compile(df, column, operator, value)

    return condition


def range_condition(column: str, low: Any = None, high: Any = None) -> Condition:
    """``low <= column <= high``, either end optional; without ends all rows pass."""

    def condition(df: DataFrame) -> Column:
        parts = []
        if low is not None:
            parts.append(_compile(df, column, ">=", low))
        if high is not None:
            parts.append(_compile(df, column, "<=", high))
        return functools.reduce(lambda a, b: a & b, parts, F.lit(True))

    return condition


def user_condition(condition: Condition | Column | str) -> Condition:
    """A function of the table, a Column or a SQL text as a condition."""
    if isinstance(condition, str):
        return lambda df: F.expr(condition)
    if isinstance(condition, Column):
        return lambda df: condition
    return condition


def all_of(conditions: Iterable[Condition], df: DataFrame) -> Column:
    """Conjunction in order; NULL counts as false where the result is used as a mask."""
    return functools.reduce(lambda a, b: a & b, (c(df) for c in conditions), F.lit(True))


def as_mask(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _compile(df: DataFrame, column: str, operator: str, value: Any) -> Column:
    kind = df.schema[column].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    cell = quoted(column)
    if operator in TEXT_OPERATORS:
        if not isinstance(kind, T.StringType):
            raise TypeError(f"'{operator}' needs a text column, {column} is {kind.simpleString()}")
        return _text(cell, operator, value)
    if operator in ("isna", "notna"):
        missing = (cell.isNull() | F.isnan(cell)) if floating else cell.isNull()
        return missing if operator == "isna" else ~missing
    if operator in ("in", "not in"):
        value = [v for v in value if is_missing(v) or _comparable(kind, v)]
        member = _member(cell, floating, list(value))
        return member if operator == "in" else ~member
    if is_missing(value) or not _comparable(kind, value):
        return F.lit(operator == "!=")
    if operator == "!=":
        return ~cell.eqNullSafe(F.lit(value))
    if operator == "==":
        return cell == value
    if operator == "<":
        return cell < value
    if operator == "<=":
        return cell <= value
    over = cell > value if operator == ">" else cell >= value
    return over & ~F.isnan(cell) if floating else over


def _comparable(kind: T.DataType, value: Any) -> bool:
    """A text never equals a number: such cells match nothing, and all of "!=" and "not in"."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return not (isinstance(kind, T.StringType) and number or isinstance(kind, T.NumericType) and isinstance(value, str))


def _text(cell: Column, operator: str, value: str) -> Column:
    if operator == "contains":
        return as_mask(cell.rlike(value))
    if operator == "startswith":
        return as_mask(cell.startswith(value))
    return as_mask(cell.endswith(value))


def _member(cell: Column, floating: bool, values: list[Any]) -> Column:
    """Membership; a missing marker in the list matches missing cells."""
    present = [v for v in values if not is_missing(v)]
    member = as_mask(cell.isin(present)) if present else F.lit(False)
    if len(present) < len(values):
        member = member | ((cell.isNull() | F.isnan(cell)) if floating else cell.isNull())
    return member
