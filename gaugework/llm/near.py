"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles, embedded as 128 minimum hashes (its tokens). Equal sets
are found first, by the tree-merge, and one of each goes on. A path is a chain of tokens that sets
share: at every node a hash of the path samples a few coordinates, and each set continues along its
own values of them. Sets that share a path form a bucket. A bucket with few sets, or one that its
last split left more than half, is a leaf and is searched by brute force; others are split on.
Independent runs repeat this until a pair at the threshold is missed with less than the wanted
probability.

A pair belongs to the first leaf that both sets share, so it is counted once and no pair is ever a
row: a leaf only reports each set's links and the set it is joined to. Leaves with many sets are cut
into blocks that are compared block by block in different tasks. Minimum hashes choose the sets of
a leaf to look at, the complete shingle sets decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.arrow import arrow_schema, key_groups, partitions, record_batch, strings
from gaugework.llm.exact import tree_merge
from gaugework.llm.graph import components
from gaugework.llm.rows import packed, quoted, unpacked
from gaugework.llm.words import WordHasher, chunks, mix, shingle_hashes
from gaugework.operators.joins import join_hot, join_keys
from gaugework.session import settled, stored

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 128
CHILDREN = 2
SPLITS = 32  # a split at least halves a bucket, so this holds for 2^32 leaves
LEAF = 256
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 21
MISSED = 1e-6


def _share(agreeing: int) -> float:
    """Of pairs at a node that their sets share the part that is lost below it, if ``SPLITS`` follow."""
    lost = 0.0
    for used in range(min(SPLITS, COORDINATES), 0, -1):
        left, good = COORDINATES - used, max(agreeing - used, 0)
        drawn = min(CHILDREN, left)
        lost = sum(math.comb(good, m) * math.comb(left - good, drawn - m) * lost**m for m in range(drawn + 1)) / math.comb(left, drawn)
    return lost


def runs_needed(similarity: float, missed: float) -> int:
    """Runs after which a pair at the threshold is missed with probability ``missed`` at most, if so few suffice.

    A run starts from one coordinate; a set then takes ``CHILDREN`` further ones at every split. All
    runs share the coordinates, so the loss is the mean over how many of them agree; pairs with
    fewer than ``least_agreement`` for half of ``missed`` are lost in any case.
    """
    least = least_agreement(similarity, missed / 2)
    likely = [math.comb(COORDINATES, a) * similarity**a * (1 - similarity) ** (COORDINATES - a) for a in range(COORDINATES + 1)]
    below = [_share(a) for a in range(COORDINATES + 1)]
    for runs in range(1, COORDINATES):
        total = sum(likely[:least])
        for a in range(least, COORDINATES + 1):
            roots = range(max(runs - COORDINATES + a, 0), min(a, runs) + 1)
            total += likely[a] * sum(math.comb(a, m) * math.comb(COORDINATES - a, runs - m) * below[a] ** m for m in roots) / math.comb(COORDINATES, runs)
        if total <= missed:
            return runs
    return COORDINATES


def least_agreement(similarity: float, missed: float) -> int:
    """The agreeing coordinates that a pair at the threshold has but for probability ``missed``."""
    tail = 0.0
    for k in range(COORDINATES + 1):
        tail += math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k)
        if tail > missed:
            return k
    return COORDINATES


def _sets(hasher: WordHasher, texts: list[bytes], k: int) -> list[np.ndarray]:
    shingles, offsets = shingle_hashes(*hasher(texts), k)
    return [np.unique(shingles[a:b]) for a, b in zip(offsets, offsets[1:])]


def _profiler(schema: pa.Schema, k: int):
    """Batches (.., text) to (.., print, n, sig): fingerprint, size and minimum hashes of the set."""

    def run(batches):
        hasher = WordHasher()
        rng = np.random.default_rng(20240229)
        factors = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
        for batch in batches:
            rest = batch.select([n for n in batch.schema.names if n != "text"])
            for first, some in chunks(t and t.lower() for t in strings(batch.column("text"))):
                sets = _sets(hasher, some, k)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                sig = np.full((len(sets), COORDINATES), np.uint32(0xFFFFFFFF))
                prints = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    for j in range(COORDINATES):
                        sig[full, j] = np.minimum.reduceat(flat * factors[j] + shifts[j], starts) >> np.uint64(32)
                    prints[full, 0] = np.add.reduceat(mix(flat + shifts[0]), starts)
                    prints[full, 1] = np.add.reduceat(mix(flat ^ shifts[1]), starts)
                some_rest = rest.slice(first, len(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        *some_rest.columns,
                        pa.array([p.tobytes() for p in prints], pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(list(sig.view(np.int32)), pa.list_(pa.int32())),
                    ],
                    schema=schema,
                )

    return run


def _set_reader(schema: pa.Schema, k: int):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for first, some in chunks(t and t.lower() for t in strings(batch.column("text"))):
                sets = _sets(hasher, some, k)
                yield record_batch(schema, row=rows[first : first + len(some)], shingles=[s.tobytes() for s in sets])

    return run


def _earlier(group: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """For every set of a leaf its earlier leaves, as (owner, number) pairs, and how many numbers there are."""
    leaf = int(group["leaf"][0])
    lists = [[x for x in own if x < leaf] for own in group["leaves"]]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names, number = np.unique(np.array([x for own in lists for x in own], np.int64), return_inverse=True)
    return owner, number, len(names)


def _partners(group: dict, similar):
    """For each set of a cell the later sets whose pair belongs to this leaf and of which ``similar`` is true."""
    m = len(group["row"])
    side = np.asarray(group["block"])
    across = group["one"][0] != group["two"][0]
    owner, number, names = _earlier(group)
    mark = np.zeros(names, bool)
    for u in range(m - 1):
        at = np.arange(u + 1, m)
        if across:
            at = at[side[at] != side[u]]
        if len(at):
            at = at[similar(u, at)]
        if len(at) and names:
            own = number[owner == u]
            if len(own):
                mark[own] = True
                met = np.zeros(m, bool)
                met[owner[mark[number]]] = True
                mark[own] = False
                at = at[~met[at]]
        if len(at):
            yield u, at


def _screen(schema: pa.Schema, similarity: float, agreement: int):
    """Of each cell the sets that have a partner by their minimum hashes."""

    def run(batches):
        for group in key_groups(batches, ["leaf", "one", "two"]):
            m = len(group["row"])
            if m < 2:
                continue
            sig, sizes = np.array(group["sig"], np.int32), np.asarray(group["n"])

            def similar(u, at):
                near = np.minimum(sizes[at], sizes[u]) >= similarity * np.maximum(sizes[at], sizes[u])
                return near & ((sig[at] == sig[u]).sum(axis=1) >= agreement)

            chosen = np.zeros(m, bool)
            for u, at in _partners(group, similar):
                chosen[u] = True
                chosen[at] = True
            if chosen.any():
                keep = np.flatnonzero(chosen)
                yield record_batch(schema, **{f.name: [group[f.name][i] for i in keep] for f in schema})

    return run


def _verify(schema: pa.Schema, similarity: float):
    """Of each cell the links of its sets (by the number of documents behind them) and their joints."""

    def run(batches):
        for group in key_groups(batches, ["leaf", "one", "two"]):
            m = len(group["row"])
            if m < 2:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            sizes = np.array([len(s) for s in sets])
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            seen = np.zeros(ids.max() + 1, bool)
            rows, weights = np.asarray(group["row"]), np.asarray(group["weight"])

            def similar(u, at):
                own = ids[ends[u] - sizes[u] : ends[u]]
                seen[own] = True
                # all later sets lie behind this one in ids
                common = np.add.reduceat(seen[ids[ends[u] :]].astype(np.int64), (ends - sizes)[u + 1 :] - ends[u])[at - u - 1]
                seen[own] = False
                return common >= similarity * (sizes[u] + sizes[at] - common) - 1e-9

            links, label = np.zeros(m, np.int64), np.arange(m)
            for u, at in _partners(group, similar):
                links[u] += weights[at].sum()
                links[at] += weights[u]
                roots = np.unique(label[np.append(at, u)])
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
            keep = np.flatnonzero(links)
            if len(keep):
                yield record_batch(schema, row=rows[keep], links=links[keep], joint=rows[label[keep]])

    return run


def _leaves(sets: DataFrame, runs: int, leaf: int) -> DataFrame:
    """(row, leaf, many, much): the leaves of every set with the number of sets and of shingles in them."""
    roots = [F.struct(F.xxhash64(F.lit(i), F.col("sig")[i]).alias("path"), F.array(F.lit(i)).alias("used")) for i in range(runs)]
    level = sets.select("row", "n", F.lit(None).cast("long").alias("above"), F.explode(F.array(*roots)).alias("p")).select("row", "n", "above", "p.*")
    found, depth = None, 0
    while True:
        level = stored(level)
        met = level.groupBy("path").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("much")).filter("many > 1")
        shared = stored(level.join(met, "path"))
        done = F.col("many") <= leaf
        if depth:
            done = done | (F.col("many") * 2 > F.col("above"))
        ended = shared.filter(done).select("row", F.col("path").alias("leaf"), "many", "much")
        found = ended if found is None else found.unionByName(ended)
        rest = shared.filter(~done)
        if rest.isEmpty():
            return found
        draws = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(8 * CHILDREN)), lambda k: F.pmod(F.xxhash64("path", k), F.lit(COORDINATES)).cast("int")))
        fresh = F.slice(F.filter(draws, lambda i: ~F.array_contains("used", i)), 1, CHILDREN)
        level = rest.select("row", "path", "used", "n", F.col("many").alias("above"), F.explode(fresh).alias("i")).join(sets.select("row", "sig"), "row")
        level = level.select(
            "row", "n", "above", F.xxhash64("path", "i", F.col("sig")[F.col("i")]).alias("path"),
            F.array_append("used", F.col("i")).alias("used"),
        )
        depth += 1


def _cells(leaves: DataFrame) -> DataFrame:
    """Every set once per cell of its leaf: a pair of blocks, or the one block of a small leaf."""
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_SETS), F.ceil(F.col("much") / BLOCK_SHINGLES))
    blocks = F.when((F.col("many") <= 2 * BLOCK_SETS) & (F.col("much") <= 2 * BLOCK_SHINGLES), 1).otherwise(F.least(blocks, F.col("many"))).cast("int")
    rows = leaves.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("row", "leaf", "block", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    missed: float = MISSED,
    leaf: int = LEAF,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_shingles, kept.

    Words are runs of characters other than ASCII white space, in lower case; a text of fewer than
    ``words`` words is one shingle. Two documents are linked when the Jaccard similarity of their
    shingle sets is at least ``similarity``; ``n_links`` counts the other documents linked to one,
    copies included. ``class_id`` is the least id of those that links connect. ``kept`` marks one
    row per class. Texts without a word (null, empty, white space) are linked to nothing and kept.
    Rows that repeat an id count as documents of their own; a null id is the lowest. Texts of any
    length are read whole. Other columns are ignored; an empty table gives an empty result.
    """
    return _verdicts(docs, doc_id, text, words, similarity, missed, leaf).drop("text_hash", "n_bytes")


def _verdicts(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, similarity: float = SIMILARITY, missed: float = MISSED, leaf: int = LEAF) -> DataFrame:
    """The rows of ``near_duplicates`` with hash and size of their own text, stored."""
    return settled(docs.sparkSession, lambda: _linked(docs, doc_id, text, words, similarity, missed, leaf))


def _linked(docs: DataFrame, doc_id: str, text: str, words: int, similarity: float, missed: float, leaf: int) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    body = quoted(text).cast("string")
    source = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    fields = f"doc_id {kind}, text_hash long, n_bytes long, row long, print binary, n long, sig array<int>"
    numbered = source.select("doc_id", "text_hash", "n_bytes", F.monotonically_increasing_id().alias("row"), "text")
    profile = stored(numbered.mapInArrow(_profiler(arrow_schema(fields), words), fields))

    full = profile.filter("n > 0").select("print", F.struct("doc_id", "row").alias("member"))
    classes = stored(tree_merge(full, ["print"], "member", largest=False).select(F.col("member.row").alias("row"), "winner", "members"))
    weights = classes.filter("row = winner.row").select("row", F.col("members").alias("weight"))
    sets = stored(profile.join(weights, "row").select("row", "doc_id", "text_hash", "n", "sig", "weight"))

    leaves = stored(_leaves(sets, runs_needed(similarity, missed), leaf).distinct())
    lists = leaves.groupBy("row").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    known = stored(sets.join(lists, "row"))
    tasks = partitions(spark)
    cell = ["leaf", "one", "two"]

    cells = _cells(leaves).join(known.select("row", "n", "sig", "leaves"), "row")
    cells = cells.repartition(tasks, *cell).sortWithinPartitions(*cell)
    fields = "row long, leaf long, block int, one int, two int"
    chosen = stored(cells.mapInArrow(_screen(arrow_schema(fields), similarity, least_agreement(similarity, missed / 2)), fields))

    wanted = chosen.select("row").distinct().join(known.select("row", "doc_id", "text_hash"), "row")
    wanted = wanted.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "inner").select("row", "text")
    fields = "row long, shingles binary"
    shingles = texts.mapInArrow(_set_reader(arrow_schema(fields), words), fields).dropDuplicates(["row"])
    shingles = stored(shingles.join(known.select("row", "n", "weight", "leaves"), "row"))
    cells = chosen.join(shingles, "row").repartition(tasks, *cell).sortWithinPartitions(*cell)
    fields = "row long, links long, joint long"
    found = stored(cells.mapInArrow(_verify(arrow_schema(fields), similarity), fields))

    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("row").alias("a"), F.col("joint").alias("b")))
    least = stored(roots.join(sets.select("row", "doc_id"), F.col("node") == F.col("row")).select("node", "root", "doc_id", "row"))
    best = least.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    joined = join_hot(least.select("node", "root"), best, "root").join(links, F.col("node") == F.col("row"))
    joined = stored(joined.select(F.col("node").alias("winner_row"), "best", "links"))

    rows = profile.select("doc_id", "text_hash", "n_bytes", "row", "n").join(classes, "row", "left")
    rows = join_hot(stored(rows.withColumn("winner_row", F.col("winner.row"))), joined, "winner_row", "left")
    winner = F.coalesce("best", "winner", F.struct("doc_id", "row"))
    others = F.coalesce("members", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    kept = (winner["row"] == F.col("row")).alias("kept")
    return rows.select("doc_id", winner["doc_id"].alias("class_id"), others.alias("n_links"), F.col("n").alias("n_shingles"), kept, "text_hash", "n_bytes")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class; all columns of the rows that stay are as they were.

    Rows are dropped by id and text, so of rows that repeat an id those with the kept texts stay, and
    of rows that repeat both one stays. Rows without a word (null, empty) all stay. Other columns may
    have any names; an empty table gives an empty result.
    """
    same = ["doc_id", "text_hash", "n_bytes"]
    verdicts = _verdicts(docs, doc_id, text, **options).groupBy(*same).agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("times"))
    gone = stored(verdicts.filter("stay < times"))
    body = quoted(text).cast("string")
    rows = packed(docs, doc_id=quoted(doc_id), text_hash=F.xxhash64(body), n_bytes=F.octet_length(body).cast("long"))
    joined = join_keys(rows, gone, same, "left")
    rest = joined.filter(F.col("stay").isNull()).select("row")
    again = joined.filter("stay > 0").dropDuplicates(same).select("row")
    return unpacked(rest.unionByName(again))
