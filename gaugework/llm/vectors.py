"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. A vector gets one more coordinate that brings all to the same
norm (queries get 0 there), so that the largest product is the smallest angle and hyperplanes can
separate it. Trees split a bounded sample at medians of random projections; every row is then sent
to its leaf of every tree. A query walks all trees at once through one priority queue that holds
nodes by how far the query lies on the wrong side of the hyperplanes above them; the leaves it pops
first are searched. How many leaves that takes is measured on the sample against brute force, for a
wanted recall. Rows and queries meet by groups of neighbouring leaves; candidates are reranked by
the exact inner product of the original vectors.

Equal vectors are one entry of the index with the few smallest identifiers, which is all that a
result can show, so many copies of a vector neither fill a leaf nor reach a task together.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugework.llm.arrow import arrow_schema, partitions, record_batch
from gaugework.session import stored

TOP = 20
TREES = 8
SAMPLE_ROWS = 16_384  # vectors that the trees are fitted on, at most
SAMPLE_VALUES = 1 << 22  # and components of them
LEAF_SAMPLE = 32  # sample vectors in a leaf
TRIALS = 256  # sample vectors that are looked up to choose the number of leaves
RECALL = 0.96  # wanted of them
SHARD_ROWS = 32_768  # index rows that meet queries in one group
QUERIES = 128  # that are compared at once
SEED = 20240311


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: neither null, empty or zero, nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def key_of(vector: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(vector).alias("k1"), F.xxhash64(F.reverse(vector), F.lit(1)).alias("k2")]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


class Forest:
    """Trees as plain arrays. ``paths[t]`` has a row of (direction, offset), ``ends[t]`` the two children of each node:
    a node if not negative, else leaf ``-1 - child``. Leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        self.scale = float(np.abs(sample).max(initial=0.0)) or 1.0
        norms = np.linalg.norm(sample / self.scale, axis=1)
        self.norm = float(norms.max(initial=0.0)) or 1.0
        points = self.lifted(sample)
        draw = np.random.default_rng(seed)
        self.paths, self.ends, self.leaves = [], [], []
        for _ in range(trees):
            directions, ends, count = [], [], 0
            todo = [(np.arange(len(points)), None)]  # depth first, left before right
            while todo:
                rows, above = todo.pop()
                split = self._split(points[rows], draw) if len(rows) > leaf else None
                if split is None:
                    me = -1 - count
                    count += 1
                else:
                    direction, left = split
                    me = len(directions)
                    directions.append(direction)
                    ends.append([0, 0])
                    todo += [(rows[~left], (me, 1)), (rows[left], (me, 0))]
                if above is not None:
                    ends[above[0]][above[1]] = me
            width = points.shape[1] + 1
            self.paths.append(np.array(directions).reshape(-1, width))
            self.ends.append(np.array(ends, np.int64).reshape(-1, 2))
            self.leaves.append(count)

    @staticmethod
    def _split(points: np.ndarray, draw) -> tuple | None:
        """A direction with the offset of its median, and who lies below; None if all project alike."""
        for _ in range(3):
            direction = draw.standard_normal(points.shape[1])
            values = points @ direction
            ordered = np.sort(values)
            half = len(values) // 2
            cut = (ordered[half - 1] + ordered[half]) / 2
            left = values < cut
            if 0 < left.sum() < len(values):
                return np.append(direction / np.linalg.norm(direction), cut / np.linalg.norm(direction)), left
        return None

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of one norm: the rest goes into one more coordinate. Rows longer than all of the sample keep none."""
        inner = vectors / self.scale / self.norm
        rest = np.sqrt(np.maximum(1.0 - (inner**2).sum(axis=1), 0.0))
        return np.hstack([inner, rest[:, None]])

    def aimed(self, vectors: np.ndarray) -> np.ndarray:
        """Queries as points: of norm 1, nothing in the last coordinate."""
        inner = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        inner = inner / np.linalg.norm(inner, axis=1, keepdims=True)
        return np.hstack([inner, np.zeros((len(inner), 1))])

    def margins(self, tree: int, points: np.ndarray) -> np.ndarray:
        """Signed distances (points x nodes) from the hyperplanes; below 0 is left."""
        path = self.paths[tree]
        return points @ path[:, :-1].T - path[:, -1]

    def leaf_of(self, tree: int, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if len(self.ends[tree]) else np.full(len(points), -1)
        rows = np.arange(len(points))
        while (inner := at >= 0).any():
            node, row = at[inner], rows[inner]
            path = self.paths[tree][node]
            right = (points[row] * path[:, :-1]).sum(axis=1) - path[:, -1] >= 0
            at[inner] = self.ends[tree][node, right.astype(int)]
        return -1 - at

    def walk(self, points: np.ndarray, wanted: int):
        """For each point its first ``wanted`` leaves of all trees, as (tree, leaf), nearest first."""
        margins = [self.margins(t, points) for t in range(len(self.paths))]
        for row in range(len(points)):
            own = [m[row].tolist() for m in margins]
            # (how far on the wrong side at the worst, tree, node)
            queue = [(-math.inf, t, 0 if len(self.ends[t]) else -1) for t in range(len(own))]
            found = []
            while queue and len(found) < wanted:
                off, tree, node = heapq.heappop(queue)
                if node < 0:
                    found.append((tree, -1 - node))
                    continue
                m, (left, right) = own[tree][node], self.children[tree][node]
                heapq.heappush(queue, (max(off, m), tree, left))
                heapq.heappush(queue, (max(off, -m), tree, right))
            yield found

    @property
    def children(self) -> list:
        if not hasattr(self, "_children"):
            self._children = [e.tolist() for e in self.ends]
        return self._children

    def leaves_for(self, sample: np.ndarray, top: int, recall: float, trials: int) -> int:
        """The leaves after which a query has found ``recall`` of its ``top`` nearest, on the sample."""
        some = np.arange(len(sample))[:: max(len(sample) // trials, 1)][:trials]
        every = sum(self.leaves)
        homes = [self.leaf_of(t, self.lifted(sample)) for t in range(len(self.paths))]
        ranks = []
        for row, found in zip(some, self.walk(self.aimed(sample[some]), every)):
            place = [np.zeros(n, np.int64) for n in self.leaves]
            for nth, (tree, leaf) in enumerate(found, 1):
                place[tree][leaf] = nth
            near = sample @ sample[row]
            near[row] = -np.inf
            best = np.argsort(-near, kind="stable")[: min(top, len(sample) - 1)]
            ranks.append(np.min([place[t][homes[t][best]] for t in range(len(place))], axis=0))
        ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
        return int(ranks[min(math.ceil(recall * len(ranks)), len(ranks)) - 1]) if len(ranks) else every


def _plain(forest: Forest) -> dict:
    """What travels to the tasks: arrays and numbers only."""
    return dict(vars(forest))


def _forest(parts: dict) -> Forest:
    forest = object.__new__(Forest)
    vars(forest).update(parts)
    return forest


def _homes(model, schema: pa.Schema, wide: list[int]):
    """Index rows to their leaf of every tree, with the shard that holds it."""

    def run(batches):
        forest = _forest(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                points = forest.lifted(matrix(part.column("v")))
                for tree in range(len(forest.paths)):
                    leaf = forest.leaf_of(tree, points)
                    shard = leaf // wide[tree]
                    head = [pa.array(np.full(len(leaf), tree, np.int32)), pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(leaf), np.int32))]
                    leaves = pa.array(leaf[:, None].astype(np.int32).tolist(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*head, part.column("k1"), part.column("k2"), leaves, part.column("v"), part.column("ids")], schema=schema)

    return run


def _walks(model, schema: pa.Schema, wide: list[int], wanted: int):
    """Queries to the shards of the leaves they search."""

    def run(batches):
        forest = _forest(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows, trees, shards, leaves = [], [], [], []
                for row, found in enumerate(forest.walk(forest.aimed(matrix(part.column("v"))), wanted)):
                    own: dict = {}
                    for tree, leaf in found:
                        own.setdefault((tree, leaf // wide[tree]), []).append(leaf)
                    for (tree, shard), some in own.items():
                        rows.append(row)
                        trees.append(tree)
                        shards.append(shard)
                        leaves.append(sorted(some))
                taken = part.take(pa.array(rows, pa.int64()))
                none = pa.nulls(len(rows), schema.field("ids").type)
                head = [pa.array(trees, pa.int32()), pa.array(shards, pa.int32()), pa.array(np.ones(len(rows), np.int32))]
                yield pa.RecordBatch.from_arrays([*head, taken.column("k1"), taken.column("k2"), pa.array(leaves, pa.list_(pa.int32())), taken.column("v"), none], schema=schema)

    return run


class Shard:
    """Index rows of neighbouring leaves of one tree."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        leaf = rows.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.vectors = matrix(rows.column("v").combine_chunks())[order]
        ids = rows.column("ids").combine_chunks().take(pa.array(order))
        self.ids, self.at = ids.flatten().to_pylist(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        self.names, starts = np.unique(leaf[order], return_index=True)
        self.bounds = np.append(starts, len(leaf))

    def search(self, queries: np.ndarray, leaves: list[list[int]], top: int):
        """(query, score, id) of the best rows in the leaves of each query, by exact inner products."""
        scores = np.full((len(queries), len(self.vectors)), -np.inf)
        owner = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        wanted = np.array([x for own in leaves for x in own], np.int64)
        for k, name in enumerate(self.names):
            who = owner[wanted == name]
            if len(who):
                a, b = self.bounds[k], self.bounds[k + 1]
                scores[who, a:b] = queries[who] @ self.vectors[a:b].T
        for q in range(len(queries)):
            own = scores[q]
            known = np.flatnonzero(own > -np.inf)
            if len(known) > top:
                least = np.partition(own[known], len(known) - top)[len(known) - top]
                known = known[own[known] >= least - 1e-9 * max(abs(least), np.abs(own[known]).max() * 1e-3)]
            exact = (queries[q] * self.vectors[known]).sum(axis=1)
            pairs = sorted((-s, i) for s, r in zip(exact.tolist(), known) for i in self.ids[self.at[r] : self.at[r + 1]])
            for s, i in pairs[:top]:
                yield q, -s, i


def _meetings(schema: pa.Schema, top: int):
    """Sorted by shard, rows before queries: the best rows of each query in each shard."""

    def searched(shard: Shard, part: pa.RecordBatch):
        found = list(shard.search(matrix(part.column("v")), part.column("leaves").to_pylist(), top))
        if found:
            at = pa.array([q for q, _, _ in found], pa.int64())
            yield record_batch(
                schema, k1=part.column("k1").take(at).to_pylist(), k2=part.column("k2").take(at).to_pylist(), vec_id=[i for _, _, i in found], score=[s for _, s, _ in found]
            )

    def run(batches):
        held, shard, last = [], None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                names = np.stack([part.column(n).to_numpy() for n in ("tree", "shard", "kind")])
                cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
                for b, c in zip(cuts, cuts[1:]):
                    tree, number, kind = names[:, b].tolist()
                    if last != (tree, number):
                        held, shard, last = [], None, (tree, number)
                    piece = part.slice(b, c - b)
                    if kind == 0:
                        held.append(piece)
                    elif held or shard:
                        if shard is None:
                            shard, held = Shard(held), []
                        for d in range(0, piece.num_rows, QUERIES):
                            yield from searched(shard, piece.slice(d, QUERIES))

    return run


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    top: int = TOP,
    trees: int = TREES,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    leaf: int = LEAF_SAMPLE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``top`` nearest rows found of each query row: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which ``is_query``, a condition on the columns of ``vectors``, holds;
    candidates are all rows with another id. ``score`` is the inner product in double precision,
    equal scores go by the smaller id. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, and neither do those of another length than most have (of
    equally many the longer). Rows with a null id take no part; rows that repeat id and vector are
    one row, an id with several vectors counts with each of them as candidate and once, with its
    best, in a result. Vectors may have any length; other columns are ignored; an empty table gives
    an empty result.

    Trees are fitted on at most ``sample_rows`` vectors drawn by hash; all rows are indexed. The
    number of leaves searched is what finds ``recall`` of the nearest vectors within the sample.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    dimension = lengths["d"] if lengths else 0
    rows = rows.filter(F.size("v") == dimension).select("vec_id", "v", "asks", *key_of(F.col("v")))

    # Of equal vectors the smallest ids: one more than a result shows, as a query leaves itself out.
    # The limit on a rank is also applied before the shuffle.
    own = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.withColumn("nth", F.dense_rank().over(own)).filter(F.col("nth") <= top + 1)
    index = few.groupBy("k1", "k2").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    index = stored(index)
    asked = stored(rows.filter("asks").select("vec_id", "k1", "k2").distinct())

    many = index.count()
    if not many:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    bound = max(min(sample_rows, SAMPLE_VALUES // dimension), 2 * leaf)
    share = F.pmod(F.col("k2"), F.lit(1 << 30)) < int(min(1.0, 1.1 * bound / many) * (1 << 30))
    sample = index.filter(share).orderBy("k2", "k1").select("v").limit(bound).toPandas()["v"]  # at most bound rows
    if not len(sample):
        sample = index.orderBy("k2", "k1").select("v").limit(bound).toPandas()["v"]
    sample = np.stack(sample.to_list()).astype(np.float64)
    forest = Forest(sample, trees, leaf, SEED)
    wanted = forest.leaves_for(sample, top, recall, TRIALS)
    model = spark.sparkContext.broadcast(_plain(forest))
    # neighbouring leaves that hold about shard_rows rows of the index
    wide = [max(math.ceil(n * shard_rows / many), 1) for n in forest.leaves]

    fields = f"tree int, shard int, kind int, k1 long, k2 long, leaves array<int>, v array<double>, ids array<{kind}>"
    homes = index.mapInArrow(_homes(model, arrow_schema(fields), wide), fields)
    asking = asked.select("k1", "k2").distinct().join(index, ["k1", "k2"]).select("k1", "k2", "v")
    walks = asking.repartition(partitions(spark), "k1").mapInArrow(_walks(model, arrow_schema(fields), wide, wanted), fields)
    both = homes.unionByName(walks).repartition(partitions(spark), "tree", "shard").sortWithinPartitions("tree", "shard", "kind")
    fields = f"k1 long, k2 long, vec_id {kind}, score double"
    met = both.mapInArrow(_meetings(arrow_schema(fields), top + 1), fields)

    best = Window.partitionBy("k1", "k2").orderBy(F.col("score").desc(), "vec_id")
    merged = met.groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
    merged = merged.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top + 1)
    lists = stored(merged.groupBy("k1", "k2").agg(F.collect_list(F.struct("score", "vec_id")).alias("near")))

    pairs = asked.withColumnRenamed("vec_id", "query_id").join(lists, ["k1", "k2"]).select("query_id", F.explode("near").alias("near"))
    pairs = pairs.filter(F.col("near.vec_id") != F.col("query_id")).groupBy("query_id", F.col("near.vec_id").alias("vec_id")).agg(F.max("near.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= top)
