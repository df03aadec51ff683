"""Exact density clustering by grid units.

Equal vectors are counted once and known by a number of their own; keys only name the clusters and
may repeat. Vectors in a grid cell whose diagonal is at most ``eps`` are neighbours of each
other, so a cell holding ``min_points`` rows is a core node as a whole and its inner pairs are
never formed. Its vectors take part as a few sub-cells with tight bounding boxes; other vectors
are boxes of one point. Two boxes are compared by their least and greatest distance, and single
vectors are compared only where that leaves a question open.

Pairs of boxes come from an equi-join on the parts of a space tree and go straight into an aggregate
over the left side; no list of pairs is kept. The tree is cut at medians of the boxes, so a crowd
is spread over parts of bounded size and a box meets the parts around it. Clusters grow by
merging every component with its least neighbouring component, which halves the number of open
components per round.

Where there are several parts, a bounded sample per part is compared first: it settles most core
questions and joins the crowd into one component. What is left is then compared in full, except
members of a part's leading component with parts that the same component leads: any edge there
starts at a unit outside that component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.functions.scalars import quoted
from gaugework.operators import spacetree
from gaugework.operators.joins import attach
from gaugework.operators.ranks import numbered
from gaugework.session import stored

EPS = 0.5
MIN_POINTS = 5
SUB_CELLS = 4
# Units per part of the space tree, about.
CROWD = 2_000
SAMPLE = 200
WRITTEN_OUT = 3


def cluster(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    eps: float = EPS,
    min_points: int = MIN_POINTS,
    label: str = "cluster",
) -> DataFrame:
    """``df`` plus a cluster number per row, -1 for noise.

    Clusters are numbered by their least core key, and of equal keys by the least vector; a border
    row takes the lowest cluster it touches. Keys may repeat or be null: they identify no row.
    """
    grid = _Grid(df, key, columns, eps, min_points)
    numbers = grid.numbers(grid.components())
    return grid.attach_to(df, grid.labels(numbers), label, F.lit(-1).cast("bigint")).withColumn(
        label, F.col(label).cast("int")
    )


def noise_flags(
    df: DataFrame, key: str, columns: Sequence[str], eps: float = EPS, min_points: int = MIN_POINTS
) -> DataFrame:
    """``df`` plus ``is_outlier`` for rows no cluster reaches; forms no clusters."""
    grid = _Grid(df, key, columns, eps, min_points)
    same = grid.core_nodes().select("node", F.lit(0).cast("bigint").alias("number"))
    reached = grid.labels(same)
    flagged = grid.attach_to(df, reached, "reached", F.lit(-1).cast("bigint"))
    return flagged.withColumn("is_outlier", F.col("reached") < 0).drop("reached")


class _Grid:
    """Distinct vectors, their units and the core flags of one table."""

    def __init__(self, df, key, columns, eps, min_points):
        self.key, self.eps, self.min_points = key, eps, min_points
        self.columns = self._varying(df, columns)
        self.d = len(self.columns)
        # a shade below eps / sqrt(d), so rounding cannot stretch a cell beyond eps
        self.side = eps / math.sqrt(max(self.d, 1)) * (1 - 1e-9)
        self.points = stored(self._points(df))
        self.units = stored(self._units())
        # without boxes of several vectors every pair of units is sure or apart
        self.boxes = not self.units.where(F.col("lo") != F.col("hi")).isEmpty()
        self.rows = self.units.count()
        self.tree = spacetree.fit(self.units, self.rows, CROWD) if self.d else None
        self.crowded = self.tree is not None
        self.units = stored(self._with_core(self.units))

    # -- layout --------------------------------------------------------------

    def _varying(self, df, columns):
        """Columns with any spread, widest first."""
        row = df.agg(*[F.max(quoted(c)) - F.min(quoted(c)) for c in columns]).first()
        spread = {c: row[i] or 0.0 for i, c in enumerate(columns)}
        return sorted((c for c in columns if spread[c] > 0), key=lambda c: -spread[c])

    def _vector(self) -> Column:
        cells = [quoted(c).cast("double") + F.lit(0.0) for c in self.columns]
        return F.array(*cells) if cells else F.array().cast("array<double>")

    def _points(self, df):
        """Distinct vectors with their number, row count, least key, node and sub-cell."""
        vectors = df.groupBy(self._vector().alias("x")).agg(F.count("*").alias("w"), F.min(quoted(self.key)).alias("key"))
        # numbers stay what they are, as the table is stored
        vectors = stored(vectors.withColumn("cell", self._cell(self.side)).withColumn("pid", F.monotonically_increasing_id()))
        cells = vectors.groupBy("cell").agg(F.sum("w").alias("rows"), F.min("pid").alias("rep"))
        dense = F.col("rows") >= self.min_points
        return vectors.join(cells, "cell").select(
            "x",
            "w",
            "key",
            "pid",
            dense.alias("dense"),
            F.when(dense, F.col("rep")).otherwise(F.col("pid")).alias("node"),
            F.when(dense, self._cell(self.side / SUB_CELLS))
            .otherwise(F.array().cast("array<bigint>"))
            .alias("sub"),
        )

    def _cell(self, side: float) -> Column:
        return F.transform("x", lambda v: F.floor(v / side))

    def _units(self):
        """One box per sub-cell of a dense cell and per vector elsewhere."""
        lows = [F.min(F.get("x", F.lit(i))) for i in range(self.d)]
        highs = [F.max(F.get("x", F.lit(i))) for i in range(self.d)]
        return self.points.groupBy("node", "dense", "sub").agg(
            F.min("pid").alias("uid"),
            F.sum("w").alias("w"),
            F.min(F.struct("key", "x")).alias("first"),
            _array(lows).alias("lo"),
            _array(highs).alias("hi"),
        )

    # -- pairs ---------------------------------------------------------------

    def _block(self) -> Column:
        """The part of the space tree in which a unit lives."""
        return spacetree.home_part(self.tree, F.col("lo"))

    def _reached(self) -> Column:
        """The parts in which units within eps of a unit can live; a unit is at most a sub-cell wide."""
        wide = self.eps * (1 + 1e-9)
        return spacetree.reached_parts(self.tree, F.col("lo"), F.col("hi"), wide + self.side / SUB_CELLS, wide)

    def _sample(self, side: DataFrame) -> DataFrame:
        """At most ``SAMPLE`` units per block, cut before the shuffle; a stored table."""
        order = Window.partitionBy("block").orderBy(F.xxhash64("uid"), "uid")
        ranked = side.withColumn("block", self._block()).withColumn("rank", F.row_number().over(order))
        return stored(ranked.where(F.col("rank") <= SAMPLE).drop("block", "rank"))

    def _pairs(
        self, left: DataFrame, right: DataFrame, leaders: DataFrame | None = None, right_rows: int | None = None
    ) -> DataFrame:
        """Unit pairs of different nodes that may be within eps.

        Columns of the sides carry the prefixes ``a_`` and ``b_``; ``sure`` tells
        that all vectors of the pair are within eps. With ``leaders`` a left unit
        that ``leads`` its block skips blocks led by its own component.

        A right side of checked size is broadcast and the left units stay spread. A
        larger one is joined by part.
        """
        if self.crowded:
            left = left.repartition(2 * left.sparkSession.sparkContext.defaultParallelism, "uid")
        a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns], F.explode(self._reached()).alias("block"))
        if leaders is not None:
            a = attach(a, leaders, ["block"]).where(~F.col("a_leads") | (F.col("leader") != F.col("a_comp"))).drop("leader")
        b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns], self._block().alias("block"))
        near, far = self._box_distances()
        limit = self.eps * self.eps
        right_rows = self.rows if right_rows is None else right_rows
        matched = attach(a, b, ["block"], known_rows=right_rows, values=2 * self.d + 4)
        matched = matched.where((F.col("a_node") != F.col("b_node")) & (near <= limit))
        return matched.withColumn("sure", far <= limit).drop("block", "a_lo", "a_hi", "b_lo", "b_hi")

    def _box_distances(self) -> tuple[Column, Column]:
        """Least and greatest squared distance between the boxes of a pair."""
        a_lo, a_hi, b_lo, b_hi = (F.col(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi"))
        if not self.boxes:
            apart = _total([a_lo, b_lo], lambda a, b: (a - b) * (a - b), self.d)
            return apart, apart

        def gap(al, ah, bl, bh):
            between = F.greatest(bl - ah, al - bh, F.lit(0.0))
            return between * between

        def reach(al, ah, bl, bh):
            across = F.greatest(bh - al, ah - bl)
            return across * across

        sides = [a_lo, a_hi, b_lo, b_hi]
        return _total(sides, gap, self.d), _total(sides, reach, self.d)

    def _members(self, prefix: str) -> DataFrame:
        """Vectors with the unit they belong to."""
        owner = self.units.select("node", "sub", "uid")
        members = self.points.join(owner, ["node", "sub"])
        return members.select(
            F.col("uid").alias(f"{prefix}_uid"), F.col("x").alias(f"{prefix}_x"), F.col("w").alias(f"{prefix}_mw")
        )

    def _member_pairs(self, open_pairs: DataFrame) -> DataFrame:
        """Unit pairs compared vector by vector; only pairs within eps remain."""
        both = open_pairs.join(self._members("a"), "a_uid").join(self._members("b"), "b_uid")
        distance = _total([F.col("a_x"), F.col("b_x")], lambda a, b: (a - b) * (a - b), self.d)
        return both.where(distance <= self.eps * self.eps)

    # -- core ----------------------------------------------------------------

    def _with_core(self, units):
        """Units of dense cells are core; single vectors are counted out."""
        left = units.where(~F.col("dense")).select("uid", "node", "w", "lo", "hi")
        right = units.select("uid", "node", "w", "lo", "hi")
        settled = None
        if self.crowded:
            few = self._sample(right)
            near = self._pairs(left, few, right_rows=few.count()).where("sure")
            weights = near.groupBy(F.col("a_uid").alias("uid"), F.col("a_w").alias("w")).agg(F.sum("b_w").alias("more"))
            settled = stored(weights.where(F.col("w") + F.col("more") >= self.min_points).select("uid"))
            left = left.join(settled, "uid", "left_anti")
        pairs = self._pairs(left, right)
        counted = pairs.groupBy("a_uid").agg(
            F.sum(F.when(F.col("sure"), F.col("b_w"))).alias("sure_w"),
            F.count_if(~F.col("sure")).alias("open"),
        )
        judged = left.join(counted, F.col("uid") == F.col("a_uid"), "left").select(
            "uid",
            (F.col("w") + F.coalesce("sure_w", F.lit(0))).alias("rows"),
            F.coalesce("open", F.lit(0)).alias("open"),
        )
        judged = stored(judged)
        short = judged.where((F.col("open") > 0) & (F.col("rows") < self.min_points)).select("uid")
        if self.boxes and not short.isEmpty():
            more = self._open_weight(left.join(short, "uid"), right)
            judged = judged.join(more, "uid", "left").withColumn("rows", F.col("rows") + F.coalesce("more", F.lit(0)))
        core = judged.where(F.col("rows") >= self.min_points).select("uid")
        if settled is not None:
            core = core.unionByName(settled)
        core = core.withColumn("found", F.lit(True))
        return units.join(core, "uid", "left").withColumn(
            "core", F.col("dense") | F.coalesce("found", F.lit(False))
        ).drop("found")

    def _open_weight(self, left, right):
        """Rows within eps among the vectors of boxes a point only partly reaches."""
        open_pairs = self._pairs(left, right).where(~F.col("sure")).select("a_uid", "b_uid")
        inside = self._member_pairs(open_pairs)
        return inside.groupBy(F.col("a_uid").alias("uid")).agg(F.sum("b_mw").alias("more"))

    def core_nodes(self) -> DataFrame:
        return self.units.where("core").select("node").distinct()

    # -- components ------------------------------------------------------------

    def components(self) -> DataFrame:
        """``node, comp``: core nodes and the least node of their component."""
        comps = stored(self.core_nodes().withColumn("comp", F.col("node")))
        if self.crowded:
            few = self._sample(self.units.where("core").select("uid", "node", "lo", "hi"))
            rows = few.count()
            comps = _merge_all(comps, lambda c: self._sampled_edges(c, few, rows))
        comps = _merge_all(comps, self._sure_edges)
        return _merge_all(comps, self._open_edges) if self.boxes else comps

    def _core_side(self, comps: DataFrame) -> DataFrame:
        return self.units.where("core").join(comps, "node").select("uid", "node", "comp", "lo", "hi")

    def _core_pairs(self, comps: DataFrame) -> DataFrame:
        """Core pairs of different components, each from at least one side."""
        side = self._core_side(comps)
        left, leaders = side, None
        if self.crowded:
            placed = side.withColumn("block", self._block())
            sizes = placed.groupBy("block", "comp").agg(F.count("*").alias("n"))
            leaders = stored(sizes.groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("leader")))
            left = attach(placed, leaders, ["block"]).withColumn("leads", F.col("comp") == F.col("leader"))
            left = left.select(*side.columns, "leads")
        return self._pairs(left, side, leaders).where(F.col("a_comp") != F.col("b_comp"))

    def _sampled_edges(self, comps: DataFrame, few: DataFrame, rows: int) -> DataFrame:
        pairs = self._pairs(self._core_side(comps), few.join(comps, "node"), right_rows=rows)
        return _both_ways(pairs.where("sure").where(F.col("a_comp") != F.col("b_comp")))

    def _sure_edges(self, comps: DataFrame) -> DataFrame:
        return _both_ways(self._core_pairs(comps).where("sure"))

    def _open_edges(self, comps: DataFrame) -> DataFrame:
        open_pairs = self._core_pairs(comps).where(~F.col("sure"))
        wanted = open_pairs.select("a_uid", "b_uid", "a_comp", "b_comp")
        return _both_ways(self._member_pairs(wanted))

    def numbers(self, comps: DataFrame) -> DataFrame:
        """``node, number``: components numbered by their least core key."""
        firsts = self.units.where("core").join(comps, "node").groupBy("comp").agg(F.min("first").alias("first"))
        return stored(comps.join(numbered(firsts.select("comp", "first.*"), ["key", "x", "comp"]).select("comp", "number"), "comp").select("node", "number"))

    # -- labels ----------------------------------------------------------------

    def labels(self, numbers: DataFrame) -> DataFrame:
        """``x, number`` for every vector that is core or touches a core vector."""
        core = self.units.where("core").join(numbers, "node")
        rest = self.units.where(~F.col("core")).select("uid", "node", "lo", "hi")
        pairs = self._pairs(rest, core.select("uid", "node", "number", "lo", "hi"))
        sure = pairs.where("sure").select("a_uid", "b_number")
        open_pairs = pairs.where(~F.col("sure")).select("a_uid", "b_uid", "b_number")
        touching = sure.unionByName(self._member_pairs(open_pairs).select("a_uid", "b_number"))
        border = touching.groupBy(F.col("a_uid").alias("uid")).agg(F.min("b_number").alias("number"))
        found = core.select("uid", "number").unionByName(border)
        members = self._members("b").withColumnRenamed("b_uid", "uid")
        return members.join(found, "uid").select(F.col("b_x").alias("x"), "number")

    def attach_to(self, df: DataFrame, labels: DataFrame, name: str, default: Column) -> DataFrame:
        """Labels of the distinct vectors back on every row."""
        labels = labels.select(F.col("x").alias("vector_"), F.col("number").alias(name))
        tagged = df.withColumn("vector_", self._vector())
        joined = attach(tagged, labels, ["vector_"], "left").drop("vector_")
        return joined.withColumn(name, F.coalesce(F.col(name), default))


def _total(sides: list[Column], term: Callable[..., Column], size: int) -> Column:
    """Sum of ``term`` over the elements of equally long arrays.

    Few elements are written out. More would make a generated method too long for
    the JVM to compile, so they are summed by array functions.
    """
    if size <= WRITTEN_OUT:
        return sum((term(*[F.get(s, F.lit(i)) for s in sides]) for i in range(size)), F.lit(0.0))
    rows = F.arrays_zip(*[s.alias(f"s{i}") for i, s in enumerate(sides)]) if len(sides) > 2 else None
    if rows is None:
        terms = F.zip_with(*sides, term)
    else:
        terms = F.transform(rows, lambda e: term(*[e[f"s{i}"] for i in range(len(sides))]))
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def _array(values: list[Column]) -> Column:
    return F.array(*values) if values else F.array().cast("array<double>")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Component edges in both directions, repeats dropped map-side."""
    edges = pairs.groupBy("a_comp", "b_comp").agg(F.lit(1).alias("one")).drop("one")
    ends = F.array(
        F.struct("a_comp", "b_comp"), F.struct(F.col("b_comp").alias("a_comp"), F.col("a_comp").alias("b_comp"))
    )
    return edges.select(F.inline(ends))


def _merge_all(comps: DataFrame, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Merge components along edges until none connects two of them."""
    while True:
        least = edges_of(comps).groupBy(F.col("a_comp").alias("comp")).agg(F.min("b_comp").alias("parent"))
        parents = stored(least)
        if parents.isEmpty():
            return comps
        roots = _roots(parents)
        comps = stored(
            comps.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        )


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``comp -> parent`` to the end; the only cycles are mutual pairs.

    A pair's lesser member becomes the root. Jumping doubles the distance each round.
    """
    back = parents.select(F.col("comp").alias("parent"), F.col("parent").alias("back"))
    is_root = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("parent"))
    jumps = stored(
        parents.join(back, "parent").select(
            "comp", F.when(is_root, F.col("comp")).otherwise(F.col("parent")).alias("root")
        )
    )
    while True:
        ahead = jumps.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        moved = stored(jumps.join(ahead, "root").select("comp", "root", "next"))
        if moved.where(F.col("root") != F.col("next")).isEmpty():
            return jumps
        jumps = moved.select("comp", F.col("next").alias("root"))
