"""Classes around one centre, hot join keys, tables deleted on the way."""

import os

from gaugework.llm import mixing
from gaugework.llm.graph import components
from gaugework.session import settled, shared_folder, stored


def test_components_of_a_hot_centre_and_a_long_path(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(5000 + i, 5001 + i) for i in range(20)] + [(7000, 7000), (7001, None)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges + edges[:9], "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1500)} | {5000 + i: 5000 for i in range(21)}


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_settled_deletes_only_what_was_stored_on_the_way(spark):
    before = set(os.listdir(shared_folder(spark)))
    outside = stored(spark.range(3))

    def inner():
        kept = settled(spark, lambda: stored(outside.selectExpr("id + 1 AS id")))
        return stored(kept).selectExpr("id * 2 AS id")

    result = settled(spark, inner)
    assert sorted(r.id for r in result.collect()) == [2, 4, 6]
    assert len(set(os.listdir(shared_folder(spark))) - before) == 2
    assert outside.count() == 3


def test_ids_in_even_steps_are_dealt_over_all_shares(spark):
    ids = spark.range(0, 256 * 20_000, 256)
    counts = [r["count"] for r in ids.groupBy(mixing.dealt(ids.id)).count().collect()]
    assert len(counts) == mixing.SHARES and max(counts) < 3 * min(counts)
