"""Many CSV files as one scan, malformed lines, staged output, stored sketch states."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import profile, sketches
from gaugework.plans.groups import ReportBuilder
from gaugework.plans.reports import ReportConfig
from gaugework.plans.runs import Director, report_sources
from gaugework.sources import metrics, sinks


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in put+1"
    folder.mkdir()
    (folder / "one.csv").write_text("time,a.x,b,note\n" + "".join(f"{1700000000 + h},{h},{h / 4},n{h}\n" for h in range(12)))
    (folder / "two.csv").write_text("time,a.x,b,note\n" + "".join(f"2024-01-01 {h:02d}:00:00,{h * 3},,7\n" for h in range(9)))
    (folder / "three.csv").write_text("time,a.x,b,note\n2024-01-02 00:00:00,none at all,2.5,\n")
    return {name: str(folder / f"{name}.csv") for name in ("one", "two", "three")}


def test_sources_equal_single_files(spark, files):
    many = metrics.read_sources(spark, files)
    assert many.by_source == {"one": ("a.x", "b"), "two": ("a.x", "b", "note"), "three": ("b", "note")}
    together = {(r["source"], r["metric_name"]): r for r in profile.profile(many.long(), keys=("source", "metric_name")).collect()}
    alone = {}
    for name, path in files.items():
        frame = metrics.read_csv(spark, path)
        assert set(many.by_source[name]) == set(frame.metrics)
        for r in profile.profile(frame).collect():
            alone[name, r["metric_name"]] = r
        rows = many.only(name).df.orderBy("time").collect()
        assert [r["time"] for r in rows] == [r["time"] for r in frame.df.orderBy("time").collect()]
    assert together.keys() == alone.keys()
    assert all(together[k].asDict() == {"source": k[0], **alone[k].asDict()} for k in alone)


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(n):
        paths = {}
        for i in range(n):
            paths[f"s{i}"] = str(tmp_path / f"{n}_{i}.csv")
            with open(paths[f"s{i}"], "w") as f:
                f.write("ts,a\n" + "".join(f"{h},{h * i}\n" for h in range(1, 6)))
        group = f"many-{n}"
        spark.sparkContext.setJobGroup(group, group)
        report_sources(spark, paths, str(tmp_path / f"out{n}"))
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12)
    assert sorted(os.listdir(tmp_path / "out12" / "metric_profiles"))[-1].startswith("source=s")


def test_a_different_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,a,b\n1,2,3\n")
    (tmp_path / "b.csv").write_text("ts,b,a\n1,2,3\n")
    with pytest.raises(Exception):
        metrics.read_sources(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}).df.collect()


def test_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write('ts,a,b\n1,2,3\n2,5\n3,"x,y",\n4,5,6,7\n')
    assert {(r["line"], r["cells"]) for r in metrics.malformed_lines(spark, path).collect()} == {("2,5", "few"), ("4,5,6,7", "many")}
    with pytest.raises(Exception, match="more than 3 cells"):
        metrics.read_text(spark, path).collect()
    with pytest.raises(Exception, match="more than 3 cells"):
        metrics.read_text(spark, path).select("a").collect()
    assert sorted(map(tuple, metrics.read_text(spark, path, malformed="drop").collect())) == [("1", "2", "3"), ("2", "5", None), ("3", "x,y", None)]
    assert metrics.read_text(spark, path, malformed="keep").count() == 4
    with pytest.raises(ValueError):
        metrics.read_text(spark, path, malformed="ignore")


def test_integers_stay_integers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,n,x,gap,big\na,3,1.5,1,99999999999999999999\nb,-4,2,,1\n")
    df = metrics.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "x": "double", "gap": "double", "big": "double"}
    assert sinks.wiki_rows(df.select("name", "n", "gap")).collect()[0]["line"] == "| a | 3 | 1.0 |"


def test_a_failing_run_leaves_nothing(spark, files, tmp_path, monkeypatch):
    written, write = [], sinks.write_csv

    def third_fails(df, path):
        written.append(path)
        if len(written) == 3:
            raise OSError("disk full")
        return write(df, path)

    monkeypatch.setattr(sinks, "write_csv", third_fails)
    out = tmp_path / "out"
    director = Director(spark, run="r")
    director.register(ReportConfig(files["one"], "f", "b", generate_visualization=False))
    results = director.process_all(str(out), fail_fast=False).collect()
    assert not results[0]["success"] and "disk full" in results[0]["error"] and len(written) == 3
    assert not out.exists() or [p for _, _, names in os.walk(out) for p in names] == []
    director.process_all(str(out))  # later it works, and again over what is there
    director.process_all(str(out))
    assert sorted(os.listdir(out / "r")) == ["b"] and len(os.listdir(out / "r" / "b")) > 4


def test_a_failing_run_keeps_what_was_there(spark, tmp_path):
    target = tmp_path / "t"
    with sinks.staged(spark, str(target)) as stage:
        sinks.write_csv(spark.range(3).toDF("n"), f"{stage}/n.csv")
    with pytest.raises(RuntimeError):
        with sinks.staged(spark, str(target)) as stage:
            sinks.write_csv(spark.range(5).toDF("n"), f"{stage}/n.csv")
            raise RuntimeError("stop")
    assert spark.read.csv(f"{target}/n.csv", header=True).count() == 3 and os.listdir(tmp_path) == ["t"]


def test_groups_with_limits_equal_single_results(spark):
    rows = [(f"m{i}", "s" if i % 2 else "t", None if i % 7 == 0 else float(i % 13), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "metric_name string, source string, x double, y int").repartition(5)
    builder = ReportBuilder(df).create_filter_group("top").add_column_filter("y", ">", 0).set_sorting(["x"], ascending=False).limit_rows(7)
    builder.create_filter_group("low").add_sort_column("y").add_sort_column("x", ascending=False).select_columns(["metric_name", "x"]).limit_rows(20)
    builder.create_filter_group("all").add_column_filter("x", ">=", 11)
    found = builder.build_results().collect()
    for name, single in builder.build_all().items():
        own = sorted((r for r in found if r["group_name"] == name), key=lambda r: r["place"] or 0)
        wanted = [r.asDict() for r in single.collect()]
        got = [{c: r[c] for c in single.columns} for r in own]
        if name == "all":
            assert {r["place"] for r in own} == {None}
            got, wanted = sorted(map(str, got)), sorted(map(str, wanted))
        else:
            assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert got == wanted, name
    each = builder.build_results(["top"], within=["source"]).collect()
    assert {(s, sum(r["source"] == s for r in each)) for s in "st"} == {("s", 7), ("t", 7)}
    plan = builder.build_results()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "WindowGroupLimit" in plan
    with pytest.raises(ValueError, match="needs a sort column"):
        ReportBuilder(df.drop("metric_name")).create_filter_group("g").limit_rows(3).build_single()


def test_large_limits_are_cut_by_shares_first(spark, monkeypatch):
    from gaugework.plans import groups

    monkeypatch.setattr(groups, "CUT_BEFORE_SHUFFLE", 5)
    df = spark.createDataFrame([(f"m{i:03d}", float(i % 17)) for i in range(300)], "metric_name string, x double").repartition(4)
    builder = ReportBuilder(df).create_filter_group("g").set_sorting(["x"]).limit_rows(40)
    found = builder.build_results().orderBy("place").collect()
    assert [r["metric_name"] for r in found] == [r["metric_name"] for r in builder.build_single("g").collect()]


def test_states_of_parts_add_up(spark):
    draw = np.random.default_rng(3)
    rows = [("a", d, float(v)) for d in range(5) for v in draw.gamma(1 + d, 2, 400)]
    rows += [("b", d, 4.25) for d in range(3)] + [("c", 0, 0.0), ("c", 1, None), ("d", 0, 7.0), ("e", 0, 1.0), ("e", 1, 2.0), ("e", 2, float("nan")), (None, 0, 3.0)]
    long = spark.createDataFrame(rows, "metric_name string, day int, value double")
    exact = {r["metric_name"]: r for r in profile.profile(long).collect()}
    states = sketches.metric_states(long, parts=["day"]).persist()
    pairs = sketches.merged_states(sketches.merged_states(states.withColumn("half", F.col("day") % 2), ["metric_name", "half"]))
    for merged in (sketches.merged_states(states), pairs):
        found = {r["metric_name"]: r for r in sketches.profile_of_states(merged).collect()}
        assert found.keys() == exact.keys() == {"a", "b", "d", "e", None}
        for name, r in found.items():
            for f in profile.PROFILE_FIELDS:
                if f not in ("metric_name", "median", "p05", "p25", "p75", "p95", "iqr"):
                    wanted = exact[name][f]
                    assert r[f] == (wanted if wanted is None else pytest.approx(wanted, rel=1e-9, abs=1e-12)), (name, f)
        errors = sketches.rank_errors(long, sketches.profile_of_states(merged)).where("metric_name = 'a'").first()
        assert max(errors[f] for f in ("p05", "p25", "median", "p75", "p95")) <= sketches.RANK_ERROR



def test_rank_errors_leave_the_values_of_a_metric_spread(spark):
    """Four metrics of any size: their values are neither shuffled nor sorted by metric."""
    long = spark.range(4000).select(F.concat(F.lit("m"), F.col("id") % 4).alias("metric_name"), (F.col("id") + 1.0).alias("value"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size is not known
    try:
        errors = sketches.rank_errors(long, profile.profile(long, quantile_mode="approx"))
        plan = errors._jdf.queryExecution().executedPlan().toString()
        assert len(errors.collect()) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sources_are_parsed_once(spark, files):
    frame = metrics.read_sources(spark, files)
    plan = frame.long()._jdf.queryExecution().optimizedPlan().toString()
    assert " csv" not in plan and "regexp_replace" not in plan.split("Join")[0]


def test_numbers_of_sources_by_the_pattern(spark, tmp_path):
    texts = ["0x1p3", "0x13", "1d", "1f", "1e5", "-3", " 4", "inf", "1_0", ".5", "5.", "7", "7.25", "1e", "0X1", "2024-01-01"]
    paths = {}
    for i, text in enumerate(texts):
        (tmp_path / f"s{i}.csv").write_text(f'time,x\n2024-01-01 00:00:00,"{text}"\n')
        paths[text] = str(tmp_path / f"s{i}.csv")
    frame = metrics.read_sources(spark, paths)
    assert [t for t in texts if frame.by_source[t]] == ["1e5", "-3", " 4", "inf", ".5", "5.", "7", "7.25"]
    found = {r["source"]: r["x"] for r in frame.df.collect()}
    assert (found["1e5"], found["-3"], found[" 4"], found["5."], found["0x1p3"], found["1d"]) == (1e5, -3.0, 4.0, 5.0, None, None)
