import csv
import glob

import pytest

from gaugework.plans.groups import ReportBuilder
from gaugework.plans.reports import ReportConfig, metric_report
from gaugework.plans.runs import Director, export_report, profiling_report
from gaugework.sources import sinks
from gaugework.sources.metrics import read_csv, read_table


@pytest.fixture
def sources(tmp_path):
    paths = []
    for i in (1, 2):
        path = tmp_path / f"{i}.csv"
        lines = ["timestamp,svc.a,svc.b,low"]
        lines += [f"2024-01-01 {h:02d}:00:00,{h * i % 7 + (20 if h == 5 else 0)},{h % 3 + 1}.5,0.{h % 2}" for h in range(24)]
        path.write_text("\n".join(lines) + "\n")
        paths.append(str(path))
    return paths


def rows(folder):
    found = []
    for part in sorted(glob.glob(f"{folder}/part-*")):
        with open(part) as f:
            found += list(csv.DictReader(f))
    return found


def test_director(spark, sources, tmp_path):
    director = Director(spark, run="2024-01-01_00-00-00")
    director.register(ReportConfig(sources[0], "max", "replaced"))
    director.register(ReportConfig(sources[0], "max", "b_max"))
    director.register(ReportConfig(sources[1], "count", "b_count", generate_visualization=False))
    del director.configs["replaced"]
    out = str(tmp_path / "report")
    results = {r["builder_name"]: r for r in director.process_all(out).collect()}
    assert list(results["b_max"]["reports_generated"]) == ["max_response_time", "instabile_service", "p25", "p75", "p95"]
    assert results["b_max"]["success"] and results["b_count"]["visualization_path"] == []
    base = f"{out}/2024-01-01_00-00-00/b_max"
    assert results["b_max"]["export_path"] == base
    profiles = rows(f"{base}/profile_max_metric_profiles.csv")
    assert sorted(r["metric_name"] for r in profiles) == ["low", "svc.a", "svc.b"]
    groups = rows(f"{base}/max_p75.csv")
    assert [r["metric_name"] for r in groups] == ["svc.a", "svc.b"] and groups[1]["p75"] == "3.50"
    assert len(rows(f"{base}/profile_max_correlations.csv")) == 3
    overview = rows(f"{base}/profile_max_overview.csv")[0]
    assert overview["total_timestamps"] == "24" and overview["start"].startswith("2024-01-01T00")
    assert len(rows(f"{base}/max_p95_distribution/histogram.csv")) == 100
    assert {r["success"]: r["n_files"] for r in director.summary().collect()} == {True: 2}


def test_failures(spark, sources, tmp_path):
    director = Director(spark)
    director.register(ReportConfig(str(tmp_path / "absent.csv"), "bad", "bad"))
    director.register(ReportConfig(sources[1], "good", "good", generate_visualization=False))
    with pytest.raises(Exception):
        director.process_all(str(tmp_path / "a"))
    director.records.clear()
    results = {r["builder_name"]: r for r in director.process_all(str(tmp_path / "b"), fail_fast=False).collect()}
    assert not results["bad"]["success"] and results["bad"]["error"] and results["good"]["success"]
    with pytest.raises(ValueError, match="no report is registered"):
        director.config("absent")
    with pytest.raises(Exception):
        director.process(director.config("bad"), str(tmp_path / "c"))


def test_single_source(spark, sources, tmp_path):
    frame = read_csv(spark, sources[0])
    report = profiling_report(frame)
    paths = export_report(report, str(tmp_path / "r"), "x")
    assert len(paths) == 4
    empty = profiling_report(frame.only(["svc.a"]))
    assert empty.correlation is None
    record = Director(spark, run="r").process(ReportConfig(sources[0], "f", "b"), str(tmp_path / "d"), with_run=False)
    assert record[2] == f"{tmp_path}/d/b" and record[5]


def test_saved_groups_skip_default(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.239, None, 3)], "metric_name string, x double, y double, n int")
    paths = sinks.save_groups({"default": df, "g": df}, "p", str(tmp_path))
    assert list(paths) == ["g"] and paths["g"].endswith("p_g.csv")
    assert rows(paths["g"]) == [{"metric_name": "a", "x": "1.24", "y": "", "n": "3"}]
    tagged = ReportBuilder(df).create_filter_group("one").build_tagged()
    folder = sinks.save_tagged(tagged, str(tmp_path / "tagged"))
    assert rows(f"{folder}/group_name=one")[0]["metric_name"] == "a"


def test_wiki(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2, True), (None, None, None, None)], "s string, x double, n int, b boolean")
    lines = [r["line"] for r in sinks.wiki_lines(df.coalesce(1)).orderBy("part").collect()]
    assert lines[0] == "|| s || x || n || b ||"
    assert set(lines[1:]) == {"| a | 1.0 | 2 | True |", "| nan | nan | nan | nan |"}
    path = sinks.write_wiki(df, str(tmp_path / "wiki"))
    first = sorted(glob.glob(f"{path}/part-*"))[0]
    assert open(first).readline() == "|| s || x || n || b ||\n"


def test_wiki_of_a_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,v\nx,0.5\ny,\n")
    lines = [r["line"] for r in sinks.wiki_rows(read_table(spark, str(tmp_path / "t.csv"))).collect()]
    assert lines == ["| x | 0.5 |", "| y | nan |"]


def test_report_setup_is_reusable(spark, sources):
    from gaugework.operators.profile import profile

    builder = metric_report(ReportBuilder(profile(read_csv(spark, sources[0]))))
    assert builder.affected_categories(["p75"]).collect()[0]["category"] == "svc"


def test_long_sources(spark, sources, tmp_path):
    frame = read_csv(spark, sources[0])
    director = Director(spark, run="r")
    director.register(ReportConfig(frame.long(), "long", "long"))
    director.register(ReportConfig(sources[0], "wide", "wide"))
    results = {r["builder_name"]: r for r in director.process_all(str(tmp_path)).collect()}
    assert all(r["success"] for r in results.values())
    by_name = lambda name: sorted(rows(f"{tmp_path}/r/{name}/profile_{name}_metric_profiles.csv"), key=lambda r: r["metric_name"])
    assert by_name("long") == by_name("wide")
    assert rows(f"{tmp_path}/r/long/profile_long_overview.csv") == rows(f"{tmp_path}/r/wide/profile_wide_overview.csv")
    assert len(results["long"]["visualization_path"]) == len(results["wide"]["visualization_path"]) > 0
