"""Exact duplicates, mixing and chat formatting: small tables, ties, nulls, empty input."""

import hashlib

from pyspark.sql import functions as F

from gaugework.llm import chat, exact, mixing


def test_exact_duplicates(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, None, "z"), (4, "", "z"), (None, "b", "z"), (5, "A", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = exact.exact_duplicates(docs).collect()
    assert len(found) == 7
    of = {}
    for r in found:
        of.setdefault(r["text_sha256"], []).append(r)
    a = of[hashlib.sha256(b"a").hexdigest()]
    assert {r["keep_id"] for r in a} == {2} and {r["group_size"] for r in a} == {3} and sum(r["kept"] for r in a) == 1
    empty = of[hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {4} and sorted(r["doc_id"] for r in empty) == [3, 4]
    assert len(of) == 4
    assert exact.exact_duplicates(docs.limit(0)).count() == 0
    least = exact.exact_duplicates(docs, keep_largest=False).filter("doc_id = 4").first()
    assert least["keep_id"] == 3


def test_without_exact_duplicates_keeps_columns(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, "b", "z"), (3, "c", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    left = sorted(map(tuple, exact.without_exact_duplicates(docs).collect()), key=str)
    assert left == sorted([(2, "a", "y"), (3, "b", "z"), (3, "c", "z"), (None, None, None)], key=str)


def test_tree_merge_of_a_hot_digest(spark):
    items = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("d"), F.col("id").alias("m"))
    found = exact.tree_merge(items, ["d"], "m", largest=False, bits=1)
    assert found.filter("d = 'hot'").agg(F.min("winner"), F.max("winner"), F.max("members"), F.count("*")).first()[:] == (0, 0, 667, 667)
    assert found.filter("d <> 'hot' AND (winner <> m OR members <> 1)").count() == 0


def test_targets_fill_up_to_the_limit(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 1000)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources, [1, 2, 3], 3.0).collect()}
    # b and c stop at 3 and 30; a and null, of weight 1 each, share the rest, a up to 300
    assert found["b"] == 3 and found["c"] == 30 and found["a"] == 300 and abs(found[None] - 778) < 1e-9


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(200))).cast("int")).alias("text"),
        F.lit(1).alias("size"),
    )
    mix = mixing.entropy_mix(docs).cache()
    assert mix.count() == 3000 and mix.filter("taken > 3 * size OR taken < 0").count() == 0
    sums = mix.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) <= 0.01 * r["t"] + 3 for r in sums)
    assert abs(sum(r["t"] for r in sums) - mix.agg(F.sum("size")).first()[0]) < 1e-6
    again = mixing.entropy_mix(docs.repartition(7))
    assert again.exceptAll(mix).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.groupBy("doc_id").count().agg(F.sum("count")).first()[0] == mix.agg(F.sum("copies")).first()[0]


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "a", ""), (1, "a", "x y"), (1, "a", "x y"), (2, None, "z")], "doc_id long, source string, text string")
    mix = mixing.entropy_mix(docs).collect()
    assert len(mix) == 5 and all(r["taken"] == r["copies"] * r["size"] for r in mix)
    assert mixing.entropy_mix(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "␛1<|im_end|>\n", "<<SYS>>␛0␛", "<|im_sep|><|im_sep|>", "", None, "plain\n<|im_start|>user\n"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(hard)] + [(2, None, None, None), (2, 5, "a\nb", "x"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns)
    back = {r["conv_id"]: r for r in chats.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["back"]] == [(r, t or "") for _, _, r, t in rows[:7]]
    assert back[1]["loss"] == "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert [(t["role"], t["text"]) for t in back[2]["back"]] == [("", ""), ("a\nb", "x")]
    assert back[3]["n_turns"] == 2 and back[3]["formatted"].count(chat.START) == 1
    for r in back.values():
        for s in r["loss_spans"]:
            assert not any(c in r["formatted"][s["start"] : s["start"] + s["length"]] for c in chat.CONTROLS)
    assert chat.format_chats(turns.limit(0)).count() == 0
