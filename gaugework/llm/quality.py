"""Quality scores by histogram gradient-boosted trees over document statistics.

One pass computes the statistics of every whole text and writes them; the trees are grown on the
statistics of a bounded sample of labelled documents, over histograms of binned values, and
flattened into arrays that score whole batches at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugework.llm.arrow import arrow_schema, strings
from gaugework.llm.toxic import labelled_sample
from gaugework.llm.words import SPACES, WordHasher, chunks, shingle_hashes
from gaugework.session import stored

SAMPLE_ROWS = 20_000  # labelled documents that the trees are grown on
TREES = 120
DEPTH = 4
BINS = 64
RATE = 0.1
RIDGE = 1.0
LEAST = 5.0  # of the second derivatives in a leaf

KINDS = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "pipe", "symbol", "bracket", "lead", "other"]
STATISTICS = [
    "bytes", "words", "lines", *[f"share_{k}" for k in KINDS], "word_length", "word_spread", "short_words", "long_words",
    "unique_words", "top_word", "repeated_next", "unique_lines", "unique_shingles", "words_a_stop", "words_a_line",
]


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("other"))
    for kind, members in {
        "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": SPACES, "newline": b"\n",
        "stop": b".!?", "comma": b",;:'\"-", "pipe": b"|", "symbol": b"#$%&*+=@^_~`/\\", "bracket": b"()[]{}<>",
    }.items():
        table[list(members)] = KINDS.index(kind)
    table[0xC0:] = KINDS.index("lead")
    return table


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of distinct values and the count of the commonest one."""
    n = len(bounds) - 1
    keys = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds)) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    owner = (keys[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(first, len(keys))))
    return np.bincount(owner, minlength=n).astype(float), most


class Statistician:
    def __init__(self):
        self.words, self.lines, self.kinds = WordHasher(), WordHasher(), _kinds()
        self.lines.table = np.zeros(256, bool)
        self.lines.table[10] = True

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """A row of ``STATISTICS`` per text; all 0 for an empty one."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        kinds = np.zeros((n, len(KINDS)))
        for a in range(0, n, 64):  # a bounded piece of the bytes at a time
            b = min(a + 64, n)
            piece = data[sizes[:a].sum() : sizes[:b].sum()]
            owner = np.repeat(np.arange(b - a), sizes[a:b])
            kinds[a:b] = np.bincount(owner * len(KINDS) + self.kinds[piece], minlength=(b - a) * len(KINDS)).reshape(-1, len(KINDS))
        words, bounds = self.words(texts)
        count = np.diff(bounds).astype(float)
        lengths = np.zeros((n, 4))
        for i, text in enumerate(texts):
            if count[i]:
                own = np.fromiter(map(len, text.split()), np.int64)
                lengths[i] = own.mean(), own.std(), (own <= 2).mean(), (own >= 14).mean()
        unique, top = _distinct(words, bounds)
        same = np.zeros(len(words) + 1)
        inner = np.ones(len(words), bool)
        inner[bounds[:-1][count > 0]] = False
        same[1:] = np.cumsum(np.append(False, words[1:] == words[:-1])[: len(words)] & inner) if len(words) else 0
        shingles, at = shingle_hashes(words, bounds, 5)
        distinct, _ = _distinct(shingles, at)
        lines, ends = self.lines(texts)
        rows = np.diff(ends).astype(float)
        unlike, _ = _distinct(lines, ends)
        safe, any_line, some = np.maximum(count, 1), np.maximum(rows, 1), np.maximum(sizes, 1)[:, None]
        return np.column_stack(
            [
                np.log1p(sizes), np.log1p(count), np.log1p(rows), kinds / some, lengths, unique / safe, top / safe, (same[bounds[1:]] - same[bounds[:-1]]) / safe,
                unlike / any_line, distinct / np.maximum(np.diff(at), 1), count / (kinds[:, KINDS.index("stop")] + 1), count / any_line,
            ]
        )


def _measure(schema: pa.Schema):
    def run(batches):
        statistician = Statistician()
        for batch in batches:
            for first, texts in chunks(strings(batch.column("text"))):
                x = statistician(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    return run


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, x. A null text counts as empty."""
    fields = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, x array<double>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_measure(arrow_schema(fields)), fields)


class Trees(NamedTuple):
    """Complete trees as arrays: the children of node k are 2k + 1 and 2k + 2."""

    feature: np.ndarray  # tree x inner node
    cut: np.ndarray  # values above go right; infinite where a node is not split
    leaf: np.ndarray  # tree x leaf
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, inner = np.full(len(x), self.base), self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss; every level of a tree is one histogram of derivatives per node and feature."""
    n, width = x.shape
    mean = min(max(y.mean(), 1e-6), 1 - 1e-6) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    open_cut = np.array([[b < len(e) for b in range(BINS)] for e in edges])  # bins that have an upper edge
    at = bins + np.arange(width) * BINS
    total = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            place = ((node - first)[:, None] * (width * BINS) + at).ravel()
            sums = [np.bincount(place, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain = np.where(open_cut[None] & (left_h >= LEAST) & (right_h >= LEAST), gain, -np.inf).reshape(many, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(many), best] > 1e-6):
                j, b = divmod(int(best[k]), BINS)
                feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = -RATE * np.bincount(node - inner, g, leaves) / (np.bincount(node - inner, h, leaves) + RIDGE)
        total = total + leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(values), base)


def _scorer(trees: Trees, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.scores(x), pa.float64())], schema=schema)

    return run


def quality(
    docs: DataFrame, labels: DataFrame, chosen: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (the share of label 1 that the trees expect).

    Trees are grown on at most ``rows`` labelled documents among ``chosen``, one of each id. Without labels of both
    kinds every score is the share of label 1, or a half if there is none. Null and empty texts
    have statistics 0 and are scored as such; repeated rows are scored alike; other columns are ignored.
    """
    ids = labelled_sample(labels, label, chosen, rows, doc_id)
    measured = stored(statistics(docs, doc_id, text))
    sample = measured.join(F.broadcast(ids), F.col("doc_id") == F.col("_label_id"))
    sample = sample.groupBy("_label_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).orderBy("_label_id").select("x", "label").toPandas()  # a row per id
    x = np.array(sample["x"].tolist()).reshape(len(sample), len(STATISTICS))
    trees = grow(x, sample["label"].to_numpy(float))
    fields = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double"
    return measured.mapInArrow(_scorer(trees, arrow_schema(fields)), fields)
