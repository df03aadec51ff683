"""Ranked lexical search, reversed: documents stream through an inverted index of the items.

The items (the queries) are few beside the documents, so it is their terms that are indexed: a block
of items becomes an inverted index from term to items, bounded in bytes and broadcast. One pass over
the texts reduces every document to its length and its counts of indexed terms; document frequencies
and totals are sums over that table. A second pass streams the counts of each document through the
index: every posting met adds its share to the score of its item, and a heap of the best documents per
item is updated. Tasks hand over their heaps only, which merge in two levels.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gaugework.llm.arrow import arrow_schema, columns, record_batch, strings
from gaugework.session import stored

TOP = 10
BLOCK_BYTES = 8 << 20  # item text that is indexed and broadcast at once
SCORED_CELLS = 1 << 20  # scores of documents x items that are held at once
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # every byte of a character beyond ASCII is 0x80 or more


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def _counter(vocabulary, schema: pa.Schema):
    """Batches (doc_id, text) to (doc_id, n, terms, counts) of the documents that have terms."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            ids, found = [], {"n": [], "terms": [], "counts": []}
            for doc, text in zip(batch.column("doc_id"), strings(batch.column("text"))):
                own = terms(text)
                if not own:
                    continue
                tally: dict[int, int] = {}
                for place in map(known.get, own):
                    if place is not None:
                        tally[place] = tally.get(place, 0) + 1
                ids.append(doc)
                found["n"].append(len(own))
                found["terms"].append(list(tally))
                found["counts"].append(list(tally.values()))
            if ids:
                yield record_batch(schema, doc_id=[d.as_py() for d in ids], **found)

    return run


class ItemIndex:
    """Postings of one block: the items of each term, and what the term weighs."""

    def __init__(self, postings: list[list[int]], weights: list[int], items: int, documents: int, total: int):
        sizes = np.array([len(p) for p in postings], np.int64)
        self.items, self.documents, self.total = items, documents, total
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.postings = np.array([i for p in postings for i in p], np.int64)
        self.weights = np.array(weights, np.int64)

    def arrays(self) -> tuple:
        return self.items, self.documents, self.total, self.sizes, self.starts, self.postings, self.weights


def _scores(index: tuple, lengths, lists, counts) -> np.ndarray:
    """Scores (documents x items), exact in 64-bit integers."""
    items, documents, total, sizes, starts, postings, weights = index
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    term = np.array([t for x in lists for t in x], np.int64)
    tf = np.array([c for x in counts for c in x], np.int64)
    out = np.zeros(len(lists) * items, np.int64)
    if len(term):
        m = np.array([10 + 90 * int(n) * documents // total for n in lengths], np.int64)
        share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
        n = sizes[term]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n)
        np.add.at(out, np.repeat(owner * items, n) + postings[place], np.repeat(share, n))
    return out.reshape(len(lists), items)


def _rank(score: int, doc) -> tuple:
    """Ascending in what comes first: score falling, then the id, null lowest."""
    return (-score, doc is not None, doc if doc is not None else 0)


def _searcher(index, schema: pa.Schema, top: int):
    """Batches (part, doc_id, n, terms, counts) to each item's best documents of the task."""

    def run(batches):
        own = index.value
        items = own[0]
        best: list[list] = [[] for _ in range(items)]  # ranks, lowest first
        least = np.ones(items, np.int64)  # what a document must reach to enter a heap
        part = 0
        rows = max(SCORED_CELLS // max(items, 1), 1)
        for batch in batches:
            cols = columns(batch)
            part = int(cols["part"][0]) if batch.num_rows else part
            for a in range(0, batch.num_rows, rows):
                docs = cols["doc_id"][a : a + rows]
                docs = docs.tolist() if isinstance(docs, np.ndarray) else docs
                scores = _scores(own, cols["n"][a : a + rows], cols["terms"][a : a + rows], cols["counts"][a : a + rows])
                for item in np.flatnonzero((scores >= least).any(axis=0)):
                    at = np.flatnonzero(scores[:, item] >= least[item])
                    fresh = [(_rank(int(scores[i, item]), docs[i]), docs[i]) for i in at]
                    best[item] = heapq.nsmallest(top, best[item] + fresh, key=lambda e: e[0])
                    if len(best[item]) == top:
                        least[item] = -best[item][-1][0][0]
        flat = [(item, doc, -rank[0]) for item, heap in enumerate(best) for rank, doc in heap]
        if flat:
            number, docs, scores = zip(*flat)
            yield record_batch(schema, part=[part] * len(flat), item=number, doc_id=docs, score=scores)

    return run


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank (from 1), doc_id, score (64-bit integer).

    Terms are runs of letters and digits of ASCII or of any characters beyond it, A-Z in lower case,
    over whole texts of any length. A term weighs ``floor(1000 ln((2N+2)/(2df+1)))`` and gives
    ``weight * (10^9 tf div (1000 tf + 8 m))`` with ``m = 10 + 90 n N div L``; all but the logarithm
    is integer arithmetic. Ranks go by score, equal scores by ascending document id (null first).
    Null and empty texts have no terms: such documents count nowhere and such items give no rows.
    Rows that repeat a document id are documents of their own; rows that repeat an item id form one
    item of all their terms. Items go to the tasks in blocks of about ``block_bytes`` of text; every
    block meets all documents. Other columns are ignored; an empty table gives an empty result.
    """
    wanted = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(math.ceil(size / block_bytes), 1)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        part = _search_block(source, rows, items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString(), top)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(source: DataFrame, rows: DataFrame, item_kind: str, doc_kind: str, top: int) -> DataFrame:
    spark = source.sparkSession
    own: dict = {}
    for row in rows.collect():  # about block_bytes of text
        own.setdefault(row["item_id"], set()).update(terms(row["text"]))
    names = sorted(own, key=lambda i: (i is not None, i if i is not None else 0))
    vocabulary = {t: k for k, t in enumerate(sorted({t for found in own.values() for t in found}))}
    postings: list[list[int]] = [[] for _ in vocabulary]
    for number, name in enumerate(names):
        for t in own[name]:
            postings[vocabulary[t]].append(number)

    fields = f"doc_id {doc_kind}, n long, terms array<int>, counts array<int>"
    counted = stored(source.mapInArrow(_counter(spark.sparkContext.broadcast(vocabulary), arrow_schema(fields)), fields))
    documents, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row per term of the block
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    index = ItemIndex(postings, weights, len(names), documents, total or 1)

    fields = f"part int, item int, doc_id {doc_kind}, score long"
    numbered = counted.filter(F.size("terms") > 0).select(F.spark_partition_id().alias("part"), "doc_id", "n", "terms", "counts")
    heaps = numbered.mapInArrow(_searcher(spark.sparkContext.broadcast(index.arrays()), arrow_schema(fields), top), fields)
    # heaps merge in groups first, so that no task takes the heaps of all tasks at once
    groups = heaps.withColumn("group", F.pmod("part", F.lit(max(math.isqrt(counted.rdd.getNumPartitions()), 1))))
    ranked = _best(_best(groups, ["item", "group"], top).drop("rank"), ["item"], top)
    known = spark.createDataFrame([(k, name) for k, name in enumerate(names)], f"item int, item_id {item_kind}")
    return ranked.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")
