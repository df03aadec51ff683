"""Whole rows beside the columns that an operator adds, whatever their own columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``row``, a struct of all columns, and the given columns of the same row."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    """The rows as they were, with further columns behind them."""
    names = df.schema["row"].dataType.names
    return df.select(*[F.col("row")[n].alias(n) for n in names], *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
