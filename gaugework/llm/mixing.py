"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Wanted are rates as near as can be to one copy of every document, by relative entropy, under a
constraint per source: the words of its documents times their rates sum to its target, and no
rate is above a limit. The convex dual has one multiplier per source, and the rate of a document
is tilted by its size, ``min(limit, exp(multiplier * size / largest size))``. Every Newton step takes
the dual's first and second derivatives as sums over the documents, of which there are as many
alike as a count per source and size says; a bracket keeps the steps from leaving what is known.

Rounding turns rates into copies along the order of size: with ``R`` the sum of the rates up to a
document it gets ``floor(R + phase) - floor(R - rate + phase)`` copies. Rates are millionths, so sums are
exact in any order. Ranks come from counts per (source, size, share), so that no task ever holds a
whole source; the phase that brings a source nearest to its target is found on those counts. The
gap that is left is closed by single copies of the smallest documents, by the same ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.llm.rows import free_name, packed, quoted, unpacked
from gaugework.operators.joins import join_keys
from gaugework.session import stored

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 64
FAR = 1e7  # the first bracket of a multiplier
CLOSE = 1e-13  # of a target, where a step is the last one
MILLION = 1_000_000
PHASES = 32
SHARES = 256
PRIME, FACTOR = 2**31 - 1, 1_327_217_885  # the factor is the golden share of 2**31


def dealt(doc_id: Column) -> Column:
    """Integer ids dealt into ``SHARES`` parts, ids in even steps too, in terms that any SQL has."""
    spread = F.pmod(F.pmod(doc_id.cast("long"), F.lit(PRIME)) * F.lit(FACTOR), F.lit(PRIME))
    return F.call_function("div", spread, F.lit(2**31 // SHARES))


def word_count(text: str | Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    The one window over all sources sees a row per source, not per document. Filling up to the
    limits has a closed form: with the sources in order of limit over weight and the first k of
    them at their limit, the level of the rest is the largest over k of what is left over by weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("_most", F.col("source_size") * F.lit(float(limit)))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("_most") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / heavy)
    rows = rows.withColumn("_level", F.max("_level").over(everything))
    return rows.withColumn("target", F.least("_most", F.col("weight") * F.col("_level"))).drop("_level", "_most")


def tilted_rates(counts: DataFrame, plan: DataFrame, limit: float) -> DataFrame:
    """(source, size, rate) of ``counts`` (source, size, n) for the targets of ``plan`` (source, source_size, target).

    A source whose target is its limit has the limit as rate, one without words or target rate 0.
    """
    sizes = counts.filter("size > 0")
    largest = plan.filter("source_size > 0 AND target > 0").filter(F.col("target") < F.lit(limit * (1 - 1e-12)) * F.col("source_size"))
    most = sizes.groupBy("source").agg(F.max("size").alias("largest"))
    state = _with_source(largest.select("source", "target"), most).select(
        "source", "target", "largest", F.lit(0.0).alias("m"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"), F.lit(False).alias("done")
    )
    state = stored(state)
    share = F.col("size") / F.col("largest")
    tilt = F.exp(F.least(F.col("m") * share, F.lit(700.0)))
    for _ in range(NEWTON_STEPS):
        sums = _with_source(sizes, state).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(limit)))).alias("words"),
            F.sum(F.when(tilt < limit, F.col("n") * F.col("size") * share * tilt).otherwise(0.0)).alias("slope"),
        )
        off = F.col("words") - F.col("target")
        lo, hi = F.when(off < 0, F.col("m")).otherwise(F.col("lo")), F.when(off > 0, F.col("m")).otherwise(F.col("hi"))
        step = F.col("m") - F.try_divide(off, F.col("slope"))
        inside = F.coalesce((step > lo) & (step < hi), F.lit(False))
        last = F.abs(off) <= CLOSE * F.col("target")
        moved = F.when(last, F.col("m")).when(inside, step).otherwise((lo + hi) / 2)
        state = stored(_with_source(state, sums).select("source", "target", "largest", moved.alias("m"), lo.alias("lo"), hi.alias("hi"), last.alias("done")))
        if state.filter("NOT done").isEmpty():
            break
    known = _with_source(counts, plan).select("source", "size", "source_size", "target")
    solved = state.select(F.col("source").alias("_s"), "m", "largest")
    rate = F.when(F.col("m").isNotNull(), F.least(tilt, F.lit(float(limit)))).otherwise(F.lit(float(limit)))
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), rate).otherwise(0.0)
    return known.join(solved, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "size", rate.alias("rate"))


def entropy_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (1, 2, 3),
    limit: float = 3.0,
    share: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    ``rate`` is the copies that the balance gives to a document of this source and size.

    ``weights`` go to the sources in code point order, null last, and repeat. A target stops at
    ``limit`` times the size of its source; the excess is shared by weight again. ``copies`` never
    exceed ``limit`` rounded up. A null or empty text has size 0 and takes no words. ``share``
    deals the documents of one size into ``SHARES`` parts (by default a hash of the id). Rows that
    repeat an id count each. Other columns are ignored; an empty table gives an empty result.
    """
    key = quoted(doc_id)
    share = F.pmod(F.xxhash64(key), F.lit(SHARES)) if share is None else share
    items = stored(docs.select(key.alias("doc_id"), quoted(source).alias("source"), word_count(quoted(text)).alias("size"), F.coalesce(share, F.lit(0)).cast("int").alias("share")))
    counts = stored(items.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = stored(targets(totals, weights, limit))
    rates = tilted_rates(counts, plan, limit)
    millionths = F.floor(F.col("rate") * MILLION + 0.5).cast("long")
    # sums of doubles depend on their order; in millionths every run has the same rates
    rates = stored(rates.withColumn("millionths", millionths).withColumn("rate", F.col("millionths") / MILLION))
    cells = _cells(items, falling=True, rates=rates)

    def whole(before, after, phase):
        """The whole copies between two sums of millionths."""
        return _millions(after + phase) - _millions(before + phase)

    phases = [(2 * k + 1) * MILLION // (2 * PHASES) for k in range(PHASES)]
    tried = _with_source(cells, plan).groupBy("source").agg(
        F.first("target").alias("target"),
        *[F.sum(F.col("size") * whole(F.col("mass"), F.col("mass") + F.col("n") * F.col("millionths"), F.lit(p))).alias(f"t{k}") for k, p in enumerate(phases)],
    )
    tries = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(p).alias("phase"), F.col(f"t{k}").alias("words")) for k, p in enumerate(phases)]
    best = F.array_min(F.array(*tries))
    plan = stored(_with_source(plan, tried.select("source", best["phase"].alias("phase"), (F.col("target") - best["words"]).alias("gap"))))

    upto = F.col("mass") + F.col("_rank") * F.col("millionths")
    number = F.when(F.col("size") > 0, whole(upto - F.col("millionths"), upto, F.col("phase"))).otherwise(F.lit(1)).cast("long")
    rounded = _with_source(_placed(items, cells, "mass", "millionths", "rate"), plan).withColumn("copies", number)
    rounded = stored(rounded.drop("mass", "millionths", "_rank"))

    # What rounding leaves of a source's gap: the smallest documents that can, take or give one copy.
    able = F.when(F.col("gap") > 0, F.col("copies") + 1 <= F.lit(limit)).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
    able_rows = rounded.filter(able)
    reached = F.col("words") + (F.col("_rank") - 0.5) * F.col("size")
    step = F.when(reached <= F.abs("gap"), F.signum("gap").cast("long")).otherwise(F.lit(0))
    mended = _placed(able_rows, _cells(able_rows, falling=False), "words").withColumn("copies", F.col("copies") + step)
    names = ["doc_id", "source", "size", "source_size", "target", "rate", "copies"]
    result = rounded.filter(~able).select(names).unionByName(mended.select(names))
    return result.withColumn("taken", F.col("copies") * F.col("size"))


def _millions(x: Column) -> Column:
    """Whole millions of a number that is not negative, without a detour by doubles."""
    return F.call_function("div", x, F.lit(MILLION).cast("long"))


def _with_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join by source, null equal to null."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _cells(items: DataFrame, falling: bool, rates: DataFrame | None = None) -> DataFrame:
    """Rows per (source, size, share) with the words before, in order of size, then share; with ``rates`` also the ``mass`` before.

    The mass of a document is its rate in millionths.
    """
    cells = stored(items.groupBy("source", "size", "share").agg(F.count(F.lit(1)).alias("n")))
    none = F.lit(0)
    sizes = cells.groupBy(F.col("source").alias("_s"), F.col("size").alias("_z")).agg(F.sum("n").alias("_n"))
    if rates is None:
        sizes = sizes.withColumns({"millionths": F.lit(0).cast("long"), "rate": F.lit(0.0)})
    else:
        own = rates.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "millionths", "rate")
        sizes = sizes.join(own, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_z") == F.col("_size"))).drop("_source", "_size")
    order = Window.partitionBy("_s").orderBy(F.col("_z").desc() if falling else F.col("_z").asc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "_s", "_z", "millionths", "rate",
        F.coalesce(F.sum(F.col("_n") * F.col("millionths")).over(order), none).alias("_mass"),
        F.coalesce(F.sum(F.col("_n") * F.col("_z")).over(order), none).alias("_words"),
    )
    share = Window.partitionBy("source", "size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_inner", F.coalesce(F.sum("n").over(share), none))
    joined = cells.join(sizes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    return stored(
        joined.select(
            "source", "size", "share", "n", "millionths", "rate",
            (F.col("_mass") + F.col("_inner") * F.col("millionths")).alias("mass"), (F.col("_words") + F.col("_inner") * F.col("size")).alias("words"),
        )
    )


def _placed(items: DataFrame, cells: DataFrame, *names: str) -> DataFrame:
    """``items`` with the named columns of their cell and their rank in it."""
    rank = F.row_number().over(Window.partitionBy("source", "size", "share").orderBy("doc_id"))
    starts = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("share").alias("_h"), *names)
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("share") == F.col("_h"))
    return items.withColumn("_rank", rank).join(starts, same).drop("_s", "_z", "_h")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, numbered from 1 in ``mix_copy``.

    If ``docs`` has a column of that name, the number gets the name with ``_`` behind it. Rows that
    share id, source and size are told apart by their order of text hash. Null and empty texts have
    size 0 and one copy. Other columns may have any names; an empty table gives an empty result.
    """
    keys = ["doc_id", "source", "size", "nth"]
    mix = entropy_mix(docs, doc_id, source, text, **options)
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.col("copies").desc()))
    mix = mix.withColumn("nth", nth).filter("copies > 0").select(*keys, "copies")
    rows = packed(docs, doc_id=quoted(doc_id), source=quoted(source), size=word_count(quoted(text)), hash=F.xxhash64(quoted(text)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("hash")))
    joined = join_keys(rows, mix, keys)
    return unpacked(joined, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(free_name(docs, "mix_copy")))
