"""Exact, linearly interpolated percentiles whose memory does not grow with a group.

Collecting and sorting a group's values in one task is done only while the largest
group, or all values together, are counted to be few. Beyond that the wanted ranks
are located by counting: each pass splits the interval that holds a rank
into equal bins, counts them map-side and keeps the one bin the rank falls into,
until that bin is small enough to sort. A metric holding most rows is spread over
all tasks in every pass, and a bin of equal values is settled without sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.operators.joins import attach
from gaugework.session import stored

SMALL_GROUP = 100_000
SMALL_TOTAL = 4_000_000
BINS = 8_192
MAX_PASSES = 24
LITERAL_GROUPS = 16
# Rank error of the approximate mode is rows / ACCURACY.
ACCURACY = 10_000
_LARGEST = 1.7976931348623157e308
# Lifts the logarithm of the least positive double above zero.
_LOG_SHIFT = 745.2


def sorted_percentiles(values: Column, n: Column, probs: Sequence[float]) -> Column:
    """Percentiles read off an ascending array of ``n`` values."""
    points = []
    for p in probs:
        position = (n - 1) * F.lit(float(p))
        share = position - F.floor(position)
        lower = F.get(values, F.floor(position).cast("int"))
        upper = F.get(values, F.ceil(position).cast("int"))
        points.append(_between(lower, upper, share))
    return F.array(*points)


def _between(lower: Column, upper: Column, share: Column) -> Column:
    return F.when(share > 0, lower * (1 - share) + upper * share).otherwise(lower)


def group_bounds(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, least and greatest value per group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    bounds: DataFrame | None = None,
    small_group: int | None = None,
    bins: int = BINS,
) -> DataFrame:
    """``keys`` plus ``q``, the exact percentiles of the non-missing ``value``.

    ``bounds`` may bring persisted ``keys, n, min, max`` that were computed anyway.
    ``small_group`` sets the largest group to collect in place of the default limits.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).alias("v")).where(F.col("v").isNotNull())
    if bounds is None:
        bounds = group_bounds(data, keys, "v").persist()
    few = small_group is None
    small_group = SMALL_GROUP if small_group is None else small_group
    bounds = bounds.where(F.col("n") > 0).select(*keys, "n", "min", "max")
    size = bounds.agg(
        F.sum("n").alias("total"),
        F.count("*").alias("groups"),
        F.count_if(F.col("n") > small_group).alias("large"),
    ).first()
    if not size["large"] or (few and size["total"] <= SMALL_TOTAL):
        return _collected(data, keys, probs)
    large = bounds.where(F.col("n") > small_group)
    counted = _counted(data, keys, large, size["large"], probs, small_group, bins)
    if size["large"] == size["groups"]:
        return counted
    rest = attach(data, large.select(*keys), keys, "left_anti", known_rows=size["large"])
    return counted.unionByName(_collected(rest, keys, probs))


def _collected(data, keys, probs):
    """Percentiles of small groups from their sorted values."""
    lists = data.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    return lists.select(*keys, sorted_percentiles(F.col("sorted"), F.size("sorted"), probs).alias("q"))


def _counted(data, keys, bounds, groups, probs, small_group, bins):
    """Percentiles of large groups by counting bins, pass by pass."""
    intervals = _whole_range(bounds, probs)
    settled, most = [], 1
    for step in range(MAX_PASSES):
        scale = _by_magnitude if step % 2 else _as_it_is
        ranks = stored(_locate(data, keys, intervals, groups, most, bins, scale))
        settled.append(ranks.where(F.col("lower").isNotNull()).select(*keys, "t", "lower", "upper"))
        open_ranks = ranks.where(F.col("lower").isNull())
        intervals = _open_intervals(open_ranks, keys)
        left = intervals.agg(
            F.max(F.array_max(F.transform("intervals", lambda s: s["rows"]))).alias("rows"),
            F.max(F.size("intervals")).alias("most"),
            F.count("*").alias("groups"),
        ).first()
        groups, most = left["groups"], left["most"]
        if (left["rows"] or 0) <= small_group:
            break
    if groups:
        settled.append(_sorted_ranks(data, keys, intervals, groups, most))
    ends = settled[0]
    for part in settled[1:]:
        ends = ends.unionByName(part)
    share = F.col("t.share")
    point = _between(F.col("lower"), F.col("upper"), share)
    entry = F.struct(F.col("t.i").alias("i"), point.alias("q"))
    return ends.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["q"]).alias("q")
    )


def _whole_range(bounds: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One interval per group, least to greatest value, holding all wanted ranks."""
    targets = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        targets.append(
            F.struct(
                F.lit(i).alias("i"),
                F.floor(position).alias("first"),
                F.ceil(position).alias("last"),
                (position - F.floor(position)).alias("share"),
            )
        )
    interval = F.struct(
        F.col("min").alias("lo"),
        F.col("max").alias("hi"),
        F.lit(0).cast("bigint").alias("below"),
        F.col("n").alias("rows"),
        F.array(*targets).alias("targets"),
    )
    others = [c for c in bounds.columns if c not in ("n", "min", "max")]
    return bounds.select(*others, F.array(interval).alias("intervals"))


def _inside(data, keys, intervals, groups, most):
    """The rows that lie in an open interval, with its ends.

    The at most ``most`` intervals of a group are disjoint and travel as plain
    columns, so the test stays in generated code. Those of a few metrics are
    written into the plan, which saves a hash lookup per row.
    """
    ends = []
    for i in range(most):
        interval = F.get("intervals", F.lit(i))
        ends += [interval["lo"].alias(f"lo{i}"), interval["hi"].alias(f"hi{i}")]
    flat = intervals.select(*keys, *ends)
    if len(keys) == 1 and groups <= LITERAL_GROUPS:
        joined = _with_literals(data, keys[0], flat)
    else:
        joined = attach(data, flat, keys, known_rows=groups)
    v = F.col("v")
    if most == 1:
        joined = joined.where((v >= F.col("lo0")) & (v <= F.col("hi0")))
        return joined.select(*keys, "v", F.col("lo0").alias("lo"), F.col("hi0").alias("hi"))
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i in reversed(range(most)):
        here = (v >= F.col(f"lo{i}")) & (v <= F.col(f"hi{i}"))
        lo = F.when(here, F.col(f"lo{i}")).otherwise(lo)
        hi = F.when(here, F.col(f"hi{i}")).otherwise(hi)
    return joined.select(*keys, "v", lo.alias("lo"), hi.alias("hi")).where(F.col("lo").isNotNull())


def _with_literals(data, key, flat):
    """The columns of ``flat`` per key as CASE expressions."""
    rows = flat.collect()
    columns = []
    for name in flat.columns[1:]:
        value = F.lit(None).cast("double")
        for row in rows:
            value = F.when(F.col(key) == F.lit(row[key]), F.lit(row[name]).cast("double")).otherwise(value)
        columns.append(value.alias(name))
    return data.select("*", *columns)


def _as_it_is(value: Column) -> Column:
    return value / 2


def _by_magnitude(value: Column) -> Column:
    """Signed logarithm that is monotone over all doubles, 0 at 0."""
    size = F.abs(value)
    return F.when(size > 0, F.signum(value) * (F.log(size) + _LOG_SHIFT)).otherwise(F.lit(0.0))


def _locate(data, keys, intervals, groups, most, bins, scale):
    """Count equal bins of each interval and find the bin of every wanted rank.

    Two neighbouring ranks in different bins are that bin's greatest value and the
    next bin's least; a bin of one value settles both. Other ranks stay open, with
    ``lower`` NULL and the bin as their next interval. Bins are equal on ``scale``,
    which alternates so that values of very different size separate quickly too.
    """

    def finite(value: Column) -> Column:
        return F.greatest(F.least(value, F.lit(_LARGEST)), F.lit(-_LARGEST))

    v, lo, hi = (scale(finite(F.col(c))) for c in ("v", "lo", "hi"))
    step = F.try_divide(v - lo, (hi - lo) / bins)
    bin_ = F.greatest(F.least(F.floor(F.coalesce(step, F.lit(0.0))), F.lit(bins - 1)), F.lit(0))
    counted = (
        _inside(data, keys, intervals, groups, most)
        .groupBy(*keys, "lo", bin_.cast("int").alias("bin"))
        .agg(F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
    )
    order = Window.partitionBy(*keys, "lo").orderBy("bin")
    ranked = counted.withColumn(
        "upto", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("following", F.lead("least").over(order))
    wanted = intervals.select(*keys, F.inline("intervals")).select(*keys, "lo", "below", "targets")
    start = F.col("below") + F.col("upto") - F.col("rows")
    end = F.col("below") + F.col("upto")
    placed = (
        attach(ranked, wanted, [*keys, "lo"], known_rows=groups * most)
        .select(*keys, "rows", "least", "most", "following",
                start.alias("start"), end.alias("end"), F.explode("targets").alias("t"))
        .where((F.col("t.first") >= F.col("start")) & (F.col("t.first") < F.col("end")))
    )
    same_bin = F.col("t.last") < F.col("end")
    one_value = F.col("least") == F.col("most")
    lower = F.when(~same_bin | one_value, F.col("most"))
    upper = F.when(~same_bin, F.col("following")).when(one_value, F.col("most"))
    return placed.select(
        *keys, "t", lower.alias("lower"), upper.alias("upper"), "rows", "least", "most", "start"
    )


def _open_intervals(open_ranks, keys):
    """The bins that still hold an unsettled rank, as one array per group."""
    bins = open_ranks.groupBy(*keys, "least").agg(
        F.first("most").alias("most"),
        F.first("start").alias("start"),
        F.first("rows").alias("rows"),
        F.collect_list("t").alias("targets"),
    )
    interval = F.struct(
        F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("below"), "rows", "targets"
    )
    return bins.groupBy(*keys).agg(F.collect_list(interval).alias("intervals"))


def _sorted_ranks(data, keys, intervals, groups, most):
    """Sort the few values left in each interval and read the ranks off."""
    values = (
        _inside(data, keys, intervals, groups, most)
        .groupBy(*keys, "lo")
        .agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    )
    wanted = intervals.select(*keys, F.inline("intervals")).select(
        *keys, "lo", "below", F.explode("targets").alias("t")
    )
    first = (F.col("t.first") - F.col("below")).cast("int")
    last = (F.col("t.last") - F.col("below")).cast("int")
    return attach(values, wanted, [*keys, "lo"], known_rows=groups * most).select(
        *keys, "t", F.get("sorted", first).alias("lower"), F.get("sorted", last).alias("upper")
    )
