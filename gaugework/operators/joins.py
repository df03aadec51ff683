"""Joins of a row table with a per-group table."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugework.session import stored

BROADCAST_ROWS = 100_000
BROADCAST_VALUES = 2_000_000
HOT_SHARE = 4_096
HOT_ROWS = 256


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    known_rows: int | None = None,
    values: int | None = None,
) -> DataFrame:
    """Join ``rows`` with one row per group from ``groups``.

    ``groups`` is broadcast only when its row count is known, or counted here, to
    be within ``BROADCAST_ROWS`` and, at ``values`` numbers a row (one per column unless
    told), within ``BROADCAST_VALUES``. A larger one is joined by shuffle, where the
    adaptive skew join splits a hot group.
    """
    if known_rows is None:
        groups = groups.persist()
        known_rows = groups.count()
    small = known_rows <= BROADCAST_ROWS and known_rows * (values or len(groups.columns)) <= BROADCAST_VALUES
    return join_keys(rows, groups, keys, how, small)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """A join by equal ``keys`` in which NULL equals NULL; the keys of ``left`` stay."""
    names = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = functools.reduce(lambda a, b: a & b, [F.col(quoted_name(k)).eqNullSafe(F.col(quoted_name(n))) for k, n in names.items()])
    joined = left.join(F.broadcast(right) if small else right, same, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*names.values())


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An inner or left join by one column, whose hot keys never meet in one task.

    ``right`` has one narrow row per key. A key is hot when it holds over ``HOT_ROWS`` rows and over
    a ``HOT_SHARE``-th of ``left``, so there are at most ``HOT_SHARE`` of them at any size: their rows
    of ``right`` are broadcast and those of ``left`` stay where they are. All others are joined by
    shuffle. NULL keys match nothing and are not shuffled. ``left`` is read more than once and should be
    a stored table.
    """
    total = left.count()
    if total <= HOT_ROWS:
        return left.join(right, key, how)
    limit = max(HOT_ROWS, total // HOT_SHARE)
    some = F.col(quoted_name(key)).isNotNull()
    present = left.filter(some)
    counts = present.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    few = F.broadcast(stored(counts.filter(F.col("_rows") > limit).select(key)))
    joined = present.join(few, key, "left_anti").join(right, key, how)
    hot_right = F.broadcast(right.join(few, key, "left_semi"))
    joined = joined.unionByName(present.join(few, key, "left_semi").join(hot_right, key, how))
    return joined.unionByName(left.filter(~some), allowMissingColumns=True) if how == "left" else joined


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
