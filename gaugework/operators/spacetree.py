"""A median tree that cuts space into parts of about equally many boxes.

The tree is fitted on a bounded sample of low corners. A box lives in the part that holds its low
corner; ``reached`` names all parts in which boxes within a distance can live. Parts follow the
boxes: where many crowd together the cuts lie close, so that a crowd is spread over many parts
and a box meets only the parts around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

SAMPLE_BOXES = 1 << 16  # low corners the tree is fitted on, at most
LEAST_SAMPLE = 8  # sampled corners in a part, at least


class SpaceTree:
    """Cuts as arrays: ``axis`` and ``cut`` of each node, and its two children; child ``-1 - k`` is part ``k``."""

    def __init__(self, corners: np.ndarray, parts: int):
        axis, cuts, ends, self.parts = [], [], [], 0
        most = max(math.ceil(len(corners) / max(parts, 1)), LEAST_SAMPLE)
        todo: list = [(np.arange(len(corners)), None)]
        while todo:
            rows, above = todo.pop()
            split = self._split(corners[rows]) if len(rows) > most else None
            if split is None:
                me = -1 - self.parts
                self.parts += 1
            else:
                me = len(axis)
                axis.append(split[0])
                cuts.append(split[1])
                ends.append([0, 0])
                low = corners[rows, split[0]] < split[1]
                todo += [(rows[~low], (me, 1)), (rows[low], (me, 0))]
            if above is not None:
                ends[above[0]][above[1]] = me
        self.axis, self.cut, self.ends = np.array(axis, np.int64), np.array(cuts), np.array(ends, np.int64).reshape(-1, 2)

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, float] | None:
        """The widest axis and a cut near its median that leaves points on both sides."""
        wide = points.max(axis=0) - points.min(axis=0)
        for at in np.argsort(-wide):
            if wide[at] <= 0:
                return None
            values = np.sort(points[:, at])
            cut = values[len(values) // 2]
            if cut == values[0]:
                cut = values[np.searchsorted(values, cut, "right")]
            return int(at), float(cut)
        return None

    def walk(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(part, rows) of every part that the ranges from ``low`` to ``high`` touch."""
        todo = [(0 if len(self.axis) else -1, np.arange(len(low)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            at, cut = self.axis[node], self.cut[node]
            todo.append((self.ends[node][0], rows[low[rows, at] < cut]))
            todo.append((self.ends[node][1], rows[high[rows, at] >= cut]))

    def home(self, corners: np.ndarray) -> np.ndarray:
        out = np.zeros(len(corners), np.int32)
        for part, rows in self.walk(corners, corners):
            out[rows] = part
        return out

    def reached(self, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(len(low))]
        for part, rows in self.walk(low, high):
            for r in rows.tolist():
                out[r].append(part)
        return out


def fit(boxes: DataFrame, rows: int, per_part: int) -> SpaceTree | None:
    """A tree over the ``lo`` corners of ``boxes``, of which there are ``rows``; None if one part holds all."""
    if rows <= per_part:
        return None
    share = min(1.0, 0.9 * SAMPLE_BOXES / rows)
    drawn = boxes if share >= 1 else boxes.where(F.pmod(F.xxhash64("lo"), F.lit(1 << 30)) < int(share * (1 << 30)))
    corners = drawn.select("lo").limit(SAMPLE_BOXES).toPandas()["lo"]  # at most SAMPLE_BOXES rows
    tree = SpaceTree(np.stack(corners.to_list()).astype(float), math.ceil(rows / per_part)) if len(corners) else None
    return tree if tree is not None and tree.parts > 1 else None


def home_part(tree: SpaceTree | None, low: Column) -> Column:
    """The part of a low corner, an array column."""
    if tree is None:
        return F.lit(0)

    @F.pandas_udf(T.IntegerType())
    def home(low: pd.Series) -> pd.Series:
        return pd.Series(tree.home(np.stack(low.to_list()).astype(float)) if len(low) else [], dtype="int32")

    return home(low)


def reached_parts(tree: SpaceTree | None, low: Column, high: Column, below: float, above: float) -> Column:
    """All parts where a box from ``below`` under ``low`` to ``above`` over ``high`` can have its low corner."""
    if tree is None:
        return F.array(F.lit(0))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reached(low: pd.Series, high: pd.Series) -> pd.Series:
        if not len(low):
            return pd.Series([], dtype=object)
        return pd.Series(tree.reached(np.stack(low.to_list()) - below, np.stack(high.to_list()) + above))

    return reached(low, high)
