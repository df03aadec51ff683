"""The shipped metric report: five groups over a profile table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gaugework.plans.groups import ReportBuilder
from gaugework.sources.metrics import MetricFrame

# Names, texts, columns and limits of the shipped report. The p95
# group filters above 1.0 although its text says 2.0.
REPORT_COLUMNS = (
    "metric_name", "mean", "median", "std_dev", "skewness", "kurtosis", "min", "max",
    "p05", "p25", "p75", "p95", "iqr", "total_records",
)
REPORT_TEXTS = {
    "max_response_time": "Max response time greater than 1.5 seconds",
    "instabile_service": "Instable services using std_dev, skewness, p25",
    "p25": "25th Percentile greater than 0.5 seconds",
    "p75": "75th Percentile greater than 1.0 seconds",
    "p95": "95th Percentile greater than 2.0 seconds",
}


@dataclass(frozen=True)
class Thresholds:
    """Lower limits of the shipped groups."""

    max: float = 1.5
    std_dev: float = 0.1
    skewness: float = 0.3
    stable_p25: float = 0.5
    p25: float = 0.5
    p75: float = 1.0
    p95: float = 1.0

    def of(self, group: str) -> dict[str, float]:
        """The limits of a group by column."""
        if group == "max_response_time":
            return {"max": self.max}
        if group == "instabile_service":
            return {"std_dev": self.std_dev, "skewness": self.skewness, "p25": self.stable_p25}
        return {group: getattr(self, group)}


SORTED_BY = {"max_response_time": ("max",), "instabile_service": ("std_dev", "skewness")}
WITH_DISTRIBUTIONS = ("instabile_service", "p95")


def metric_report(builder: ReportBuilder, limits: Thresholds = Thresholds()) -> ReportBuilder:
    """Declare the five groups on a builder over a profile table."""
    for group, text in REPORT_TEXTS.items():
        builder.create_filter_group(group, text)
        for column, limit in limits.of(group).items():
            builder.add_column_filter(column, ">", limit)
        columns = SORTED_BY.get(group, (group,))
        if len(columns) == 1:
            builder.set_sorting(columns, ascending=False)
        else:
            for column in columns:
                builder.add_sort_column(column, ascending=False)
        builder.select_columns(REPORT_COLUMNS)
        if group in WITH_DISTRIBUTIONS:
            builder.add_visualization()
    return builder


@dataclass(frozen=True)
class ReportConfig:
    """One source and the report to run on it.

    ``source`` is a CSV path, a ready ``MetricFrame`` or a long table with ``ts``, ``metric_name`` and
    ``value``, which gets no correlation matrix; ``setup`` declares groups.
    """

    source: str | MetricFrame | DataFrame
    file_name: str
    builder_name: str
    generate_visualization: bool = True
    setup: Callable[[ReportBuilder], ReportBuilder] = field(default=metric_report)
