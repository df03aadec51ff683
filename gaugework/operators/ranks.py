"""Consecutive numbers over a sorted table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.session import stored


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """``df`` with a number from 0 per row in ``order``, which should have no ties.

    Rows are dealt to range partitions and counted there; only one row per partition meets in a
    window, so no task holds the table.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the low 33 bits of the id count the rows of a partition
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    rows = stored(rows)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
