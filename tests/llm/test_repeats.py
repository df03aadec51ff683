"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugework.llm.repeats import dealt_anchors, merged, repeated_anchors, repeated_bytes


def brute(texts, length):
    """Per text: bytes, removed bytes, runs, digest of the rest."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = ["ab", "né", "xyz", "q", "lorem", "zz "]
    passages = ["".join(draw.choice(words) for _ in range(n)) for n in (20, 30, 60)]
    texts = []
    for _ in range(60):
        parts = ["".join(draw.choice(words) + str(draw.randint(0, 99)) for _ in range(draw.randint(0, 30))) for _ in range(2)]
        texts.append(draw.choice([*passages, ""]).join(parts))
    return texts + [texts[0], texts[0], passages[2], "a" * 300, "", None, "short", "short"]


@pytest.mark.parametrize("group", [8192, 3])
def test_matches_brute_force(spark, group):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, body string")
    rows = repeated_bytes(docs, length=40, gram=8, group=group).orderBy("doc_id").collect()
    assert [tuple(r[1:5]) for r in rows] == brute(texts, 40)
    for r, t in zip(rows, texts):
        assert r["n_removed"] == sum(s["stop"] - s["start"] for s in r["removed"])


def test_repeated_ids_nulls_and_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "ab" * 30), (1, "ab" * 30), (None, "cd" * 5), (None, None)], schema)
    rows = repeated_bytes(docs, length=40, gram=8).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 60, 60, 1), (1, 60, 60, 1), (None, 10, 0, 0), (None, 0, 0, 0)], key=str)
    assert repeated_bytes(docs.limit(0), length=40, gram=8).count() == 0


def test_no_task_holds_a_hot_anchor(spark):
    hot = [(7, i % 50, i) for i in range(4000)]
    rows = hot + hot[:300] + [(100 + i // 2, 60 + i, 0) for i in range(400)] + [(1000 + i, 70 + i, 0) for i in range(400)]
    each = spark.createDataFrame([(h, b"%d" % k, p, p - 5, p + h % 3) for h, k, p in rows], "hash long, key binary, place int, first int, last int")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        members = repeated_anchors(each)
        found = members.withColumn("task", F.spark_partition_id()).collect()
        dealt = dealt_anchors(members, 500).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r)[:5] for r in found) == sorted((h, b"%d" % k, p, p - 5, p + h % 3) for h, k, p in set(rows) if h < 1000)
    assert Counter((r["hash"], r["buckets"]) for r in dealt) == {(7, 8): 4000} | {(100 + i, 1): 2 for i in range(200)}
    assert len({r["bucket"] for r in dealt if r["hash"] == 7}) == 8
    assert max(Counter(r["task"] for r in found).values()) < 1500
    assert max(Counter(r["task"] for r in dealt).values()) < 1500


def test_merged():
    assert merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
