"""Reports over many sources: profile them together, then write each source's tables."""

from __future__ import annotations

import datetime
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.operators import distribution
from gaugework.operators.correlation import correlation_wide
from gaugework.operators.joins import attach
from gaugework.operators.profile import overview, overview_long, profile, summary
from gaugework.plans.groups import ReportBuilder
from gaugework.plans.reports import ReportConfig, metric_report
from gaugework.sources.metrics import METRIC, SOURCE, MetricFrame, read_csv, read_sources, union_sources
from gaugework.sources import sinks

RUN_SCHEMA = (
    "file_name string, builder_name string, export_path string, reports_generated array<string>, "
    "visualization_path array<string>, success boolean, error string"
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ProfilingReport:
    """The lazy tables of one source; ``correlation`` is None below two metrics."""

    overview: DataFrame
    profiles: DataFrame
    correlation: DataFrame | None
    summary: DataFrame


def profiling_report(frame: MetricFrame, quantile_mode: str = "exact") -> ProfilingReport:
    profiles = profile(frame, quantile_mode=quantile_mode)
    matrix = correlation_wide(frame) if len(frame.metrics) > 1 else None
    return ProfilingReport(overview(frame), profiles, matrix, summary(profiles))


def export_report(report: ProfilingReport, folder: str, prefix: str = "") -> list[str]:
    """Write the report as CSV folders; an empty profile table is skipped."""
    tables = {"summary": report.summary, "overview": sinks.rounded_text(sinks.flat_overview(report.overview))}
    if not report.profiles.isEmpty():
        tables["metric_profiles"] = report.profiles
    if report.correlation is not None:
        tables["correlations"] = report.correlation
    return [sinks.write_csv(df, f"{folder}/{prefix}_{name}.csv") for name, df in tables.items()]


def distributions(readings: DataFrame) -> dict[str, DataFrame]:
    """The distribution tables of all metrics in a long table."""
    return {
        "histogram": distribution.histogram(readings),
        "density": distribution.kde(readings),
        "markers": distribution.markers(readings),
        "shape": distribution.shape_with_zeros(readings),
    }


def group_readings(long: DataFrame, group: DataFrame) -> DataFrame:
    """The readings of the metrics in a group, by a semi join."""
    return attach(long, group.select(METRIC).distinct(), [METRIC], "left_semi")


def profile_sources(frames: dict[str, MetricFrame | DataFrame]) -> DataFrame:
    """Profiles of several sources from one job, keyed by source and metric."""
    return profile(union_sources(frames), keys=(SOURCE, METRIC))


def overview_sources(frames: dict[str, MetricFrame | DataFrame]) -> DataFrame:
    return overview_long(union_sources(frames), keys=(SOURCE,))


def report_sources(
    spark: SparkSession,
    paths: Mapping[str, str],
    folder: str,
    setup: Callable[[ReportBuilder], ReportBuilder] = metric_report,
    quantile_mode: str = "exact",
) -> dict[str, str]:
    """Profiles, overview, summary and groups of many CSV sources of one header, and where they are.

    All sources are one scan and every table is one write with a folder per source (groups: per
    source and group), so the number of jobs does not grow with the sources. The tables appear
    together when all are written; a failure leaves nothing.
    """
    long = read_sources(spark, paths).long()
    profiles = profile(long, keys=(SOURCE, METRIC), quantile_mode=quantile_mode).persist()
    groups = setup(ReportBuilder(profiles)).build_results(within=[SOURCE])
    tables = {
        "metric_profiles": (profiles, [SOURCE]),
        "overview": (sinks.rounded_text(sinks.flat_overview(overview_long(long, keys=(SOURCE,)))), [SOURCE]),
        "summary": (summary(profiles, keys=(SOURCE,)), [SOURCE]),
        "groups": (sinks.rounded_text(groups), [SOURCE, "group_name"]),
    }
    try:
        with sinks.staged(spark, folder) as stage:
            for name, (df, by) in tables.items():
                sinks.write_parts(df, f"{stage}/{name}", by)
    finally:
        profiles.unpersist()
    return {name: f"{folder}/{name}" for name in tables}


@dataclass
class Director:
    """Runs registered report configurations and keeps a record per source.

    Output goes to ``<folder>/<run>/<builder>``; the run name is the time the
    director was made.
    """

    spark: SparkSession
    configs: dict[str, ReportConfig] = field(default_factory=dict)
    records: list[tuple] = field(default_factory=list)
    run: str = field(default_factory=lambda: datetime.datetime.now().strftime("%Y-%m-%d_%H-%M-%S"))

    def register(self, config: ReportConfig) -> None:
        """Add a configuration; the same builder name replaces the earlier one."""
        self.configs[config.builder_name] = config

    def config(self, name: str) -> ReportConfig:
        if name not in self.configs:
            raise ValueError(f"no report is registered as {name!r}; there are {sorted(self.configs)}")
        return self.configs[name]

    def process(self, config: ReportConfig, folder: str, with_run: bool = True) -> tuple:
        """Profile one source and write everything its report asks for."""
        try:
            frame = self._frame(config)
            return self._write(config, frame, profile(frame), folder, with_run)
        except Exception as error:
            self._failed(config, error)
            raise

    def process_all(self, folder: str, with_run: bool = True, fail_fast: bool = True) -> DataFrame:
        """Run every registered configuration; profiles come from one shared job.

        With ``fail_fast`` the first failure ends the run, else it is recorded and
        the other sources go on.
        """
        frames: dict[str, MetricFrame | DataFrame] = {}
        for name, config in self.configs.items():
            try:
                frames[name] = self._frame(config)
            except Exception as error:
                self._failed(config, error)
                if fail_fast:
                    raise
        if frames:
            shared = profile_sources(frames).persist()
            for name, frame in frames.items():
                config = self.configs[name]
                profiles = shared.where(F.col(SOURCE) == name).drop(SOURCE)
                try:
                    self._write(config, frame, profiles, folder, with_run)
                except Exception as error:
                    self._failed(config, error)
                    if fail_fast:
                        raise
            shared.unpersist()
        return self.results()

    def results(self) -> DataFrame:
        return self.spark.createDataFrame(self.records, RUN_SCHEMA)

    def summary(self) -> DataFrame:
        """Sources per outcome."""
        return self.results().groupBy("success").agg(F.count("*").alias("n_files"))

    def _frame(self, config: ReportConfig) -> MetricFrame | DataFrame:
        if isinstance(config.source, (MetricFrame, DataFrame)):
            return config.source
        return read_csv(self.spark, config.source)

    def _failed(self, config: ReportConfig, error: Exception) -> None:
        self.records.append((config.file_name, config.builder_name, None, [], [], False, str(error)))

    def _write(self, config, frame, profiles, folder, with_run) -> tuple:
        parts = [folder, self.run, config.builder_name] if with_run else [folder, config.builder_name]
        target = "/".join(parts)
        profiles = profiles.persist()
        try:
            with sinks.staged(self.spark, target) as stage:
                wide = isinstance(frame, MetricFrame)
                matrix = correlation_wide(frame) if wide and len(frame.metrics) > 1 else None
                about = overview(frame) if wide else overview_long(frame)
                report = ProfilingReport(about, profiles, matrix, summary(profiles))
                export_report(report, stage, f"profile_{config.file_name}")
                builder = config.setup(ReportBuilder(profiles))
                groups = builder.build_all()
                sinks.save_groups(groups, config.file_name, stage)
                drawn = self._distributions(config, frame, builder, groups, stage)
        finally:
            profiles.unpersist()
        drawn = [path.replace(stage, target, 1) for path in drawn]
        record = (config.file_name, config.builder_name, target, list(groups), drawn, True, None)
        self.records.append(record)
        return record

    def _distributions(self, config, frame, builder, groups, target) -> list[str]:
        """Tables for the flagged groups; a failure here is only a warning.

        The metrics of a wide source are columns, so a group names the few columns to read; the
        readings of a long source are joined with the group.
        """
        if not config.generate_visualization:
            return []
        paths = []
        for name in builder.visualizations:
            path = f"{target}/{config.file_name}_{name}_distribution"
            try:
                if isinstance(frame, MetricFrame):
                    wanted = [row[METRIC] for row in groups[name].select(METRIC).collect()]
                    readings = frame.only(wanted).long() if wanted else None
                else:
                    readings = None if groups[name].isEmpty() else group_readings(frame, groups[name])
                if readings is None:
                    continue
                for table, df in distributions(readings).items():
                    sinks.write_csv(df, f"{path}/{table}.csv")
                paths.append(path)
            except Exception as error:
                log.warning("no distribution for %s: %s", name, error)
        return paths
