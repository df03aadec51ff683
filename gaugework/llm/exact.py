"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gets a digest of its whole text and a leaf run. A run holds one entry per digest: the
identifier that stays and the number of rows. In each round ``2 ** bits`` runs meet and become one
run; equal digests merge into one entry that retains the winning identifier. Runs are exchanged by
(run, digest), so a merge node is itself spread over all tasks. The verdicts then travel back down
the same tree: an entry of a run looks up its parent run, and at most ``2 ** bits`` entries share a
parent, so a text that a third of all rows repeat never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gaugework.llm.rows import packed, quoted, unpacked
from gaugework.operators.joins import join_keys
from gaugework.session import stored


def leaf_runs(df: DataFrame) -> int:
    """The number of leaf runs: the least power of two that reaches the shuffle partitions."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(wanted - 1, 1).bit_length()


def tree_merge(items: DataFrame, digest: Sequence[str], member: str, largest: bool = True, bits: int = 3) -> DataFrame:
    """``items`` with ``winner`` (the member that stays for its digest) and ``members`` (rows of it).

    ``digest`` columns must not be null; ``member`` orders the rows of a digest, nulls lowest.
    """
    digest = list(digest)
    best = F.max if largest else F.min
    leaves = leaf_runs(items)
    items = stored(items.withColumn("_run", F.pmod(F.xxhash64(member), F.lit(leaves))))
    levels = [stored(items.groupBy("_run", *digest).agg(best(member).alias("winner"), F.count(F.lit(1)).alias("members")))]
    width = leaves
    while width > 1:
        width = (width - 1 >> bits) + 1
        merged = levels[-1].withColumn("_run", F.shiftright("_run", bits)).groupBy("_run", *digest)
        levels.append(stored(merged.agg(best("winner").alias("winner"), F.sum("members").alias("members"))))
    known = levels[-1].filter("members > 1")
    for run in reversed(levels[:-1]):
        entry = run.select(*digest, "_run", F.shiftright("_run", bits).alias("_up"))
        above = known.withColumnRenamed("_run", "_up")
        known = stored(entry.join(above, [*digest, "_up"]).drop("_up"))
    found = known.withColumnRenamed("_run", "_leaf").select(
        *[F.col(d).alias(f"_{d}") for d in digest], "_leaf", "winner", "members"
    )
    match = reduce(lambda a, b: a & b, [items[d] == found[f"_{d}"] for d in digest]) & (items["_run"] == found["_leaf"])
    joined = items.join(found, match, "left")
    return joined.select(
        *[items[c] for c in items.columns if c != "_run"],
        F.coalesce(found["winner"], items[member]).alias("winner"),
        F.coalesce(found["members"], F.lit(1)).cast("long").alias("members"),
    )


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256, their 64-bit hash and their length in bytes are all equal;
    the three are compared at every level of the tree. A null text counts as empty. Of equal texts
    the largest (or smallest) identifier stays; a null identifier is the lowest. Rows that repeat
    identifier and text count in ``group_size`` and exactly one of them is kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.struct(quoted(doc_id).alias("id"), F.monotonically_increasing_id().alias("row")).alias("member"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
        F.xxhash64(body).alias("check"),
        F.octet_length(body).alias("bytes"),
    )
    groups = tree_merge(narrow, ["sha", "check", "bytes"], "member", keep_largest)
    return groups.select(
        F.col("member.id").alias("doc_id"),
        F.col("winner.id").alias("keep_id"),
        F.col("members").alias("group_size"),
        (F.col("member.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = True) -> DataFrame:
    """``docs`` with one row of each text; all its columns stay as they are.

    Null and empty texts are one text, of which one row stays. Of rows that repeat id and text one
    stays. Texts of any length are read whole; other columns may have any names; an empty table
    gives an empty result.
    """
    same = ["doc_id", "sha"]
    verdicts = exact_duplicates(docs, doc_id, text, keep_largest).select("doc_id", F.col("text_sha256").alias("sha"), "kept")
    counted = verdicts.groupBy(*same).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times"))
    gone = stored(counted.filter("NOT stays OR times > 1"))
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    joined = join_keys(packed(docs, doc_id=quoted(doc_id), sha=F.sha2(body, 256)), gone, same, "left")
    rest = joined.filter(F.col("stays").isNull()).select("row")
    again = joined.filter("stays").dropDuplicates(same).select("row")  # repeated rows of a text that stays
    return unpacked(rest.unionByName(again))
