from gaugework.operators import distribution, joins
from gaugework.operators import quantiles as Q


def test_large_group_tables_are_joined_by_shuffle(spark, long_frame, monkeypatch):
    df = long_frame({f"m{i}": [float(j * (i + 3) % 17) for j in range(60)] for i in range(20)})

    def results():
        q = Q.percentiles(df, ["metric_name"], "value", (0.1, 0.5), small_group=10, bins=4)
        h = distribution.histogram(df, bins=5)
        return sorted(map(tuple, q.collect())), sorted(map(tuple, h.collect()))

    expected = results()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert results() == expected


def test_attach_checks_the_size(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    groups = spark.range(10).selectExpr("id AS k", "id * 2 AS w")

    def logical(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "ResolvedHint (strategy=broadcast)" in logical(joins.attach(rows, groups, ["k"]))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    assert "broadcast" not in logical(joins.attach(rows, groups, ["k"]))
    assert joins.attach(rows, groups, ["k"]).count() == 1000
