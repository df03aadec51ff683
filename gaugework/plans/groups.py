"""Named filter groups over one table, compiled to DataFrames.

Groups are declared with chained calls. Nothing runs until a result is used; the
tagged and the summary form answer all groups that share their transformations
from one scan.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.functions.predicates import (
    Condition,
    all_of,
    as_mask,
    column_condition,
    range_condition,
    user_condition,
)
from gaugework.functions.scalars import name_prefix, nan_to_null, quoted
from gaugework.sources.metrics import METRIC

Transformation = Callable[[DataFrame], DataFrame]

# Columns of the tagged scan while it is limited.
GROUP, PLACE, SHARE, SPREAD = "_group", "_place", "_share", "_spread"
CUT_BEFORE_SHUFFLE = 1_000  # ranks up to which Spark limits a window before the shuffle


@dataclass(frozen=True)
class GroupSpec:
    """What a group does: transform, filter, sort, select, limit, in that order."""

    name: str
    description: str = ""
    transformations: tuple[Transformation, ...] = ()
    filters: tuple[Condition, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    sort_ascending: bool = True
    sort_label: str = "[]"
    columns: tuple[str, ...] = ()
    limit: int = 0
    visualize: bool = False


class ReportBuilder:
    """Declares filter groups over ``df`` and builds their results.

    ``tie_key`` names the column that completes the sort order under a limit, so a
    top-k is the same on every run; by default the metric name, where there is one.
    """

    def __init__(self, df: DataFrame, tie_key: str | None = None):
        self.df = df
        self.tie_key = tie_key or (METRIC if METRIC in df.columns else None)
        self.current: str | None = None
        self.groups: dict[str | None, GroupSpec] = {None: GroupSpec(name="")}

    # -- declaring -----------------------------------------------------------

    def create_filter_group(self, group_name: str, description: str = "", reset: bool = True):
        """Select a new group; an existing one is emptied unless ``reset`` is False."""
        self.current = group_name
        if reset or group_name not in self.groups:
            self.groups[group_name] = GroupSpec(name=group_name, description=description)
        return self

    def switch_group(self, group_name: str):
        self.current = self._known(group_name).name
        return self

    def add_filter(self, condition: Condition | Column | str):
        return self._extend(filters=(user_condition(condition),))

    def add_multiple_filters(self, conditions: Iterable[Condition | Column | str]):
        return self._extend(filters=tuple(user_condition(c) for c in conditions))

    def add_column_filter(self, column: str, operator: str, value: Any = None):
        return self._extend(filters=(column_condition(column, operator, value),))

    def add_range_filter(self, column: str, min_val: Any = None, max_val: Any = None):
        return self._extend(filters=(range_condition(column, min_val, max_val),))

    def add_transformation(self, transformation: Transformation):
        return self._extend(transformations=(transformation,))

    def set_sorting(self, columns: Sequence[str], ascending: bool = True):
        """Replace the sort keys, one direction for all."""
        return self._set(
            sort=tuple((c, ascending) for c in columns),
            sort_ascending=ascending,
            sort_label=str(list(columns)),
        )

    def add_sort_column(self, column: str, ascending: bool = True):
        """Append a sort key with its own direction."""
        sort = (*self._spec.sort, (column, ascending))
        return self._set(sort=sort, sort_label=str(list(sort)))

    def select_columns(self, columns: Sequence[str]):
        return self._set(columns=tuple(columns))

    def limit_rows(self, limit: int):
        """Keep the first rows of the result; 0 means all."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        return self._set(limit=limit)

    def add_visualization(self):
        """Ask for distribution tables of the metrics in this group."""
        return self._set(visualize=True)

    @property
    def visualizations(self) -> list[str]:
        return [s.name for s in self.named() if s.visualize]

    # -- building ------------------------------------------------------------

    def named(self) -> list[GroupSpec]:
        return [spec for name, spec in self.groups.items() if name]

    def get_group_configuration(self, group_name: str | None = None) -> GroupSpec:
        return self._known(group_name or self.current)

    def build_single(self, group_name: str | None = None) -> DataFrame:
        """Result of one group, by default the current one."""
        spec = self._known(group_name or self.current)
        return self._single(spec, spec.columns)

    def _single(self, spec: GroupSpec, columns: Sequence[str] | None) -> DataFrame:
        df = self._transformed(spec.transformations)
        result = df.where(all_of(spec.filters, df)) if spec.filters else df
        sort = self._limit_order(spec, df) if spec.limit else spec.sort
        if sort:
            result = result.orderBy(*[_sort_key(df, c, ascending) for c, ascending in sort])
        if columns:
            result = result.select(*[quoted(c) for c in columns])
        return result.limit(spec.limit) if spec.limit else result

    def build_all(self) -> dict[str, DataFrame]:
        """Result of every named group in the order of creation."""
        return {spec.name: self.build_single(spec.name) for spec in self.named()}

    def build_tagged(self, names: Sequence[str] | None = None) -> DataFrame:
        """Filtered rows of all groups in one table, tagged with ``group_name``.

        Groups with the same transformations share one scan. Sorting, selection and
        limits belong to the single results and are not applied here.
        """
        parts = []
        for chain, specs in self._by_transformations(names).items():
            df = self._transformed(chain)
            masks = [all_of(s.filters, df) for s in specs]
            tags = [F.when(mask, F.lit(s.name)) for mask, s in zip(masks, specs)]
            tag = F.explode(F.array_compact(F.array(*tags))).alias("group_name")
            # rows of no group are dropped first, by a filter that can reach the scan
            wanted = df.where(functools.reduce(lambda a, b: a | b, masks))
            parts.append(wanted.select(tag, *[quoted(c) for c in df.columns]))
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def build_results(self, names: Sequence[str] | None = None, within: Sequence[str] = ()) -> DataFrame:
        """The results of all groups in one table, as ``build_all`` has them one by one.

        ``within`` names columns, such as a source, that are always shown and whose values have results
        of their own: limits and places count in each of them.

        Columns: ``group_name``, ``place`` (from 1 in the order of a limited group, else NULL) and every
        column that a group shows; columns a group does not select are NULL in its rows. Groups with
        the same transformations share one scan. A limited group keeps its first rows as a ranked
        window, which Spark also cuts in every task before the shuffle; limits beyond what it cuts
        there are first applied to shares of a group. Unlimited rows are not sorted here.
        """
        parts = []
        for chain, specs in self._by_transformations(names).items():
            df = self._transformed(chain)
            masks = [all_of(s.filters, df) for s in specs]
            tags = [F.when(mask, F.lit(k)) for k, mask in enumerate(masks)]
            tagged = df.where(functools.reduce(lambda a, b: a | b, masks)).select(
                F.explode(F.array_compact(F.array(*tags))).alias(GROUP), *[quoted(c) for c in df.columns]
            )
            shows = lambda s, c: not s.columns or c in s.columns or c in within
            shown = [c for c in df.columns if any(shows(s, c) for s in specs)]
            place = F.lit(None).cast("int")
            if any(s.limit for s in specs):
                tagged, place = self._limited(tagged, df, specs, within), F.when(_of(specs, lambda s: s.limit > 0), F.col(PLACE))
            cells = [
                quoted(c) if all(shows(s, c) for s in specs)
                else F.when(_of(specs, lambda s, c=c: shows(s, c)), quoted(c)).alias(c)
                for c in shown
            ]
            name = F.get(F.array(*[F.lit(s.name) for s in specs]), GROUP)
            parts.append(tagged.select(name.alias("group_name"), place.alias("place"), *cells))
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _limited(self, tagged: DataFrame, df: DataFrame, specs: Sequence[GroupSpec], within: Sequence[str]) -> DataFrame:
        """``tagged`` with at most ``limit`` rows of each limited group, numbered in ``PLACE``."""
        keys = []
        for k, spec in enumerate(specs):
            for column, ascending in self._limit_order(spec, df) if spec.limit else ():
                # the keys of other groups are NULL in all rows of a group and order nothing
                keys.append(_sort_key(df, column, ascending, lambda cell, k=k: F.when(F.col(GROUP) == k, cell)))
        most = max(s.limit for s in specs)
        limit = F.get(F.array(*[F.lit(s.limit or 1) for s in specs]), GROUP)
        # every row of an unlimited group is alone
        alone = F.when(_of(specs, lambda s: s.limit > 0), F.lit(-1)).otherwise(F.monotonically_increasing_id())
        rows = tagged.withColumn(SHARE, alone)
        partition = [GROUP, SHARE, *[quoted(c) for c in within]]
        if most > CUT_BEFORE_SHUFFLE:
            rows = rows.withColumn(SPREAD, F.spark_partition_id())
            own = F.row_number().over(Window.partitionBy(*partition, SPREAD).orderBy(*keys))
            rows = rows.withColumn(PLACE, own).where(F.col(PLACE) <= limit).drop(SPREAD)
        ranked = rows.withColumn(PLACE, F.row_number().over(Window.partitionBy(*partition).orderBy(*keys)))
        return ranked.where((F.col(PLACE) <= most) & (F.col(PLACE) <= limit))

    def _limit_order(self, spec: GroupSpec, df: DataFrame) -> tuple[tuple[str, bool], ...]:
        """The sort keys of a limited group, completed by the tie key; it needs at least one."""
        sort = spec.sort
        if self.tie_key in df.columns and self.tie_key not in [c for c, _ in sort]:
            sort = (*sort, (self.tie_key, True))
        if not sort:
            raise ValueError(f"the limit of {spec.name!r} needs a sort column or a tie key")
        return sort

    def build_combined(self, group_names: Sequence[str], operation: str = "intersection") -> DataFrame:
        """Base rows that pass all ("intersection") or any ("union") of the groups.

        Only filters count here, and each row appears at most once per occurrence.
        """
        if operation not in ("intersection", "union"):
            raise ValueError(f"groups combine by intersection or union, not {operation!r}")
        masks = [as_mask(all_of(self._known(n).filters, self.df)) for n in group_names]
        if operation == "intersection":
            combined = functools.reduce(lambda a, b: a & b, masks, F.lit(True))
        else:
            combined = functools.reduce(lambda a, b: a | b, masks, F.lit(False))
        return self.df.where(combined)

    def get_summary_report(self) -> DataFrame:
        """Per named group: its settings, input rows, result rows and their share.

        One aggregate per distinct chain of transformations.
        """
        parts = []
        for chain, specs in self._by_transformations(None).items():
            df = self._transformed(chain)
            passed = [F.count_if(all_of(s.filters, df)).alias(f"g{i}") for i, s in enumerate(specs)]
            row = df.agg(F.count("*").alias("rows"), *passed)
            base = F.lit(self.df.count()) if chain else F.col("rows")
            row = row.withColumn("original_rows", base)
            lines = [_summary_line(s, F.col(f"g{i}")) for i, s in enumerate(specs)]
            parts.append(row.select(F.inline(F.array(*lines))))
        return functools.reduce(DataFrame.unionByName, parts)

    def affected_categories(self, names: Sequence[str] | None = None) -> DataFrame:
        """Per group the distinct metric-name prefixes of its result rows; "default" is left out."""
        wanted = [s.name for s in self.named()] if names is None else list(names)
        parts = []
        open_ended = [n for n in wanted if n != "default" and not self._known(n).limit]
        if open_ended:
            tagged = self.build_tagged(open_ended)
            parts.append(tagged.select("group_name", METRIC))
        for name in wanted:
            if name != "default" and self._known(name).limit:
                rows = self._single(self._known(name), [METRIC])
                parts.append(rows.select(F.lit(name).alias("group_name"), METRIC))
        if not parts:
            raise ValueError("no filter group is declared")
        rows = functools.reduce(DataFrame.unionByName, parts)
        return rows.select("group_name", name_prefix(F.col(METRIC)).alias("category")).distinct()

    def group_counts(self) -> DataFrame:
        """Result rows per group from the tagged scan, limits applied; groups without rows are absent."""
        found = self.build_tagged().groupBy("group_name").agg(F.count("*").alias("n_rows"))
        limits = {s.name: s.limit for s in self.named() if s.limit}
        if not limits:
            return found
        most = F.coalesce(*[F.when(F.col("group_name") == n, F.lit(m)) for n, m in limits.items()])
        return found.withColumn("n_rows", F.least("n_rows", most.cast("bigint")))

    # -- helpers -------------------------------------------------------------

    @property
    def _spec(self) -> GroupSpec:
        return self.groups[self.current]

    def _set(self, **changes: Any):
        self.groups[self.current] = dataclasses.replace(self._spec, **changes)
        return self

    def _extend(self, **more: tuple):
        return self._set(**{k: getattr(self._spec, k) + v for k, v in more.items()})

    def _known(self, name: str | None) -> GroupSpec:
        if name not in self.groups:
            raise ValueError(f"no filter group is called {name!r}")
        return self.groups[name]

    def _transformed(self, chain: Iterable[Transformation]) -> DataFrame:
        return functools.reduce(DataFrame.transform, chain, self.df)

    def _by_transformations(self, names):
        wanted = self.named() if names is None else [self._known(n) for n in names]
        chains: dict[tuple, list[GroupSpec]] = {}
        for spec in wanted:
            chains.setdefault(spec.transformations, []).append(spec)
        if not chains:
            raise ValueError("no filter group is declared")
        return chains


def _of(specs: Sequence[GroupSpec], wanted: Callable[[GroupSpec], bool]) -> Column:
    """Whether a tagged row is of one of the wanted groups."""
    return F.col(GROUP).isin([k for k, s in enumerate(specs) if wanted(s)])


def _sort_key(df: DataFrame, column: str, ascending: bool, within: Callable[[Column], Column] | None = None) -> Column:
    """Missing last in both directions."""
    cell = quoted(column)
    if dict(df.dtypes).get(column) in ("double", "float"):
        cell = nan_to_null(cell)
    cell = within(cell) if within else cell
    return cell.asc_nulls_last() if ascending else cell.desc_nulls_last()


def _summary_line(spec: GroupSpec, passed: Column) -> Column:
    kept = F.least(passed, F.lit(spec.limit).cast("bigint")) if spec.limit else passed
    return F.struct(
        F.lit(spec.name).alias("group_name"),
        F.lit(spec.description).alias("description"),
        F.lit(len(spec.filters)).alias("filter_count"),
        F.lit(spec.sort_label).alias("sort_columns"),
        F.lit(spec.sort_ascending).alias("sort_ascending"),
        F.lit(str(len(spec.columns)) if spec.columns else "All").alias("selected_columns"),
        F.lit(str(spec.limit) if spec.limit else "No limit").alias("row_limit"),
        F.lit(len(spec.transformations)).alias("transformations_count"),
        F.col("original_rows"),
        kept.alias("filtered_rows"),
        F.round(F.try_divide(kept, F.col("original_rows")) * 100, 2).alias("remaining_percentage"),
    )


def from_constraints(
    df: DataFrame, constraints: Iterable[dict], reset: bool = True, tie_key: str | None = None
) -> ReportBuilder:
    """Groups from ``{group, column, op, value}`` rows.

    With ``reset`` a repeated group name starts over, so its last row wins; without
    it the rows of a group add up.
    """
    builder = ReportBuilder(df, tie_key)
    for row in constraints:
        builder.create_filter_group(row["group"], reset=reset)
        builder.add_column_filter(row["column"], row["op"], row["value"])
    return builder
