"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so tokens get theirs first: over a bounded sample of labelled documents, in a
Spark aggregate, words and word beginnings that occur far more often in toxic documents form a list,
and its members are the labelled tokens of toxic documents. The field is trained on sentences of
that sample (features: the word, its beginnings and its ending; two states, transitions). Scoring
runs the forward and backward passes over every token of every text; marginals give the spans, and
a logistic model of their sums and maximum, fitted on the sample, gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugework.llm.arrow import arrow_schema, record_batch, strings
from gaugework.llm.words import WordHasher, chunks, mix
from gaugework.session import stored

SAMPLE_ROWS = 20_000  # labelled documents that a model is fitted on
SAMPLE_CHAINS = 30_000  # sentences that the field is trained on
VOCABULARY = 20_000
LISTED = 2_000
CHAIN = 64
BREAKS = b".!?\n"
PARTS = ("word", "begin4", "begin6", "end4")
ROUNDS = 120


class Tokens(NamedTuple):
    parts: np.ndarray  # token x part: hashes, 0 where a word is too short for a part
    chains: np.ndarray  # where chains begin, and the end
    texts: np.ndarray  # where the tokens of each text begin, and the end
    begins: np.ndarray  # code points in their text
    ends: np.ndarray


def same_length_lower(text: str | None) -> str:
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokenize(hasher: WordHasher, texts: list[bytes]) -> Tokens:
    """Chains are sentences, cut after ``CHAIN`` words; none crosses a text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends, words = hasher.block(data)
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * hasher.up[: len(data)], out=total[1:])
    parts = np.zeros((len(starts), len(PARTS)), np.uint64)
    parts[:, 0] = words
    length = ends - starts
    for column, (size, back) in enumerate(((4, False), (6, False), (4, True)), start=1):
        long = length >= size
        a = ends[long] - size if back else starts[long]
        parts[long, column] = mix((total[a + size] - total[a]) * hasher.down[a] + np.uint64(column * 1_000_003))
    broken = np.cumsum(np.isin(data, np.frombuffer(BREAKS, np.uint8)))[starts] if len(starts) else np.zeros(0, int)
    first = np.ones(len(starts), bool)
    first[1:] = broken[1:] != broken[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0)) if len(starts) else np.zeros(0, int)
    first |= (np.arange(len(starts)) - begin) % CHAIN == 0
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = np.searchsorted(starts, at)
    base = np.repeat(points[at[:-1]], np.diff(bounds))
    return Tokens(parts, np.append(np.flatnonzero(first), len(starts)), bounds, points[starts] - base, points[ends] - base)


class Lookup:
    """Places in a sorted list of hashes; a bit table answers for most that are missing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(44)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places, and the number of keys for what is missing."""
        place = np.full(hashes.shape, len(self.keys), np.int32)
        if not len(self.keys):
            return place
        chosen = self.maybe[hashes >> self.shift]
        some = hashes[chosen]
        found = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        place[chosen] = np.where(self.keys[found] == some, found, len(self.keys))
        return place


class Chains:
    """Chains in falling order of length, so that those still running are a prefix."""

    def __init__(self, bounds: np.ndarray):
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        self.starts, self.length = bounds[:-1][order], length[order]
        self.longest = int(length.max(initial=0))
        self.running = np.searchsorted(-self.length, -np.arange(self.longest + 1), "left")  # with length over t

    def passes(self, odds: np.ndarray, start: np.ndarray, move: np.ndarray):
        """Scaled forward and backward vectors; ``odds`` is the weight of state 1 to state 0 of each token."""
        n = len(odds)
        a0, a1, b0, b1 = np.ones(n), np.ones(n), np.ones(n), np.ones(n)
        for t in range(self.longest):
            at = self.starts[: self.running[t]] + t
            if t:
                p0, p1 = a0[at - 1], a1[at - 1]
                x0, x1 = p0 * move[0, 0] + p1 * move[1, 0], (p0 * move[0, 1] + p1 * move[1, 1]) * odds[at]
            else:
                x0, x1 = np.full(len(at), start[0]), start[1] * odds[at]
            total = x0 + x1
            a0[at], a1[at] = x0 / total, x1 / total
        for t in range(self.longest - 2, -1, -1):
            at = self.starts[: self.running[t + 1]] + t
            n0, n1 = b0[at + 1], b1[at + 1] * odds[at + 1]
            y0, y1 = move[0, 0] * n0 + move[0, 1] * n1, move[1, 0] * n0 + move[1, 1] * n1
            total = y0 + y1
            b0[at], b1[at] = y0 / total, y1 / total
        return a0, a1, b0, b1

    def marginals(self, odds, start, move) -> np.ndarray:
        a0, a1, b0, b1 = self.passes(odds, start, move)
        return a1 * b1 / (a0 * b0 + a1 * b1)


class Field(NamedTuple):
    keys: np.ndarray
    weights: np.ndarray  # one more, 0, for missing features
    bias: float
    start: np.ndarray
    move: np.ndarray
    logistic: np.ndarray
    rate: float


def odds_of(places: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.exp(np.clip(weights[places].sum(axis=1) + bias, -15, 15))


def train_field(places: np.ndarray, labels: np.ndarray, bounds: np.ndarray, n_keys: int) -> tuple:
    """Maximum conditional likelihood with a small ridge; moment-scaled gradient steps."""
    chains = Chains(bounds)
    inner = np.ones(len(labels), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (labels[at - 1], labels[at]), 1)
    seen_start = np.bincount(labels[bounds[:-1]], minlength=2)
    theta = np.zeros(n_keys + 1 + 1 + 2 + 4)  # weights, missing, bias, start, moves
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1.0 / max(len(bounds) - 1, 1)
    flat, width = places.ravel(), places.shape[1]
    for step in range(1, ROUNDS + 1):
        weights, bias = theta[: n_keys + 1], theta[n_keys + 1]
        start, move = np.exp(theta[n_keys + 2 : n_keys + 4]), np.exp(theta[n_keys + 4 :].reshape(2, 2))
        odds = odds_of(places, weights, bias)
        a0, a1, b0, b1 = chains.passes(odds, start, move)
        p = a1 * b1 / (a0 * b0 + a1 * b1)
        off = p - labels
        grad = np.zeros_like(theta)
        grad[: n_keys + 1] = np.bincount(flat, np.repeat(off, width), n_keys + 1)
        grad[n_keys] = 0
        grad[n_keys + 1] = off.sum()
        first = p[bounds[:-1]]
        grad[n_keys + 2 : n_keys + 4] = np.array([(1 - first).sum(), first.sum()]) - seen_start
        pair = [a * move[i, j] * (odds[at] if j else 1.0) * b for i, a in enumerate((a0[at - 1], a1[at - 1])) for j, b in enumerate((b0[at], b1[at]))]
        total = sum(pair)
        grad[n_keys + 4 :] = np.array([(x / total).sum() for x in pair]) - seen_move.ravel()
        grad = grad * scale + 1e-5 * theta
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        theta = theta - 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        theta[n_keys] = 0
    return theta[: n_keys + 1], theta[n_keys + 1], np.exp(theta[n_keys + 2 : n_keys + 4]), np.exp(theta[n_keys + 4 :].reshape(2, 2))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def summary(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: largest marginal, logarithm of their sum, share of the words, 1 if there is no word."""
    out = np.zeros((len(bounds) - 1, 4))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        n = np.diff(bounds)[full]
        total = np.add.reduceat(p, bounds[:-1][full])
        out[full, 0] = np.maximum.reduceat(p, bounds[:-1][full])
        out[full, 1] = np.log1p(total)
        out[full, 2] = total / (n + 10)
    out[np.diff(bounds) == 0, 3] = 1
    return out


def field_marginals(field: Field, lookup: Lookup, tokens: Tokens) -> np.ndarray:
    return Chains(tokens.chains).marginals(odds_of(lookup(tokens.parts), field.weights, field.bias), field.start, field.move)


def document_scores(field: Field, x: np.ndarray) -> np.ndarray:
    """The scores of texts with the summaries ``x``."""
    if not len(field.logistic):
        return np.full(len(x), field.rate)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ field.logistic, -30, 30)))


def labelled_sample(labels: DataFrame, label: str, chosen: Column, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids of the chosen ones, by hash order; repeated ids count once, as their largest label."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & chosen)
    known = known.groupBy(F.col(doc_id).alias("_label_id")).agg(F.max(label).cast("int").alias("label"))
    return stored(known.orderBy(F.xxhash64("_label_id"), "_label_id").limit(rows))


def fit(docs: DataFrame, labels: DataFrame, chosen: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Field:
    """A field from at most ``rows`` labelled documents among ``chosen``, one of each id; null texts count as empty.

    Without labels of both kinds the field has no features and every score is the share of label 1.
    """
    spark = docs.sparkSession
    ids = labelled_sample(labels, label, chosen, rows, doc_id)
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = sample.join(F.broadcast(ids), F.col("doc_id") == F.col("_label_id"))  # broadcast: at most ``rows`` ids
    sample = stored(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))  # a row per id
    size = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    positive, negative = size[1] or 0, size[0] - (size[1] or 0)
    rate = positive / max(size[0], 1)
    none = Field(np.zeros(0, np.uint64), np.zeros(1), -15.0, np.ones(2), np.ones((2, 2)), np.zeros(0), rate)
    if not positive or not negative:
        return none

    counts = sample.select("text", "label").mapInArrow(_count_parts, "part long, column int, pos long, neg long")
    counts = counts.groupBy("part", "column").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    expected = (F.col("pos") + F.col("neg")) * rate
    z = (F.col("pos") - expected) / F.sqrt(expected + 1)
    scored = stored(counts.filter("pos + neg >= 3").withColumn("z", z))
    listed = scored.filter("z >= 3.5 AND pos > 2 * neg").orderBy(F.col("z").desc(), "part").limit(LISTED).select("part").toPandas()
    vocabulary = scored.orderBy(F.abs("z").desc(), "part").limit(VOCABULARY).select("part").toPandas()
    keys = np.unique(vocabulary["part"].to_numpy(np.int64).view(np.uint64))
    bad = np.unique(listed["part"].to_numpy(np.int64).view(np.uint64))

    chains = sample.mapInArrow(_chain_reader(keys, bad), "draw long, n int, places binary, labels binary")
    rows_ = chains.orderBy("draw", "places").limit(SAMPLE_CHAINS).toPandas()
    if not len(rows_):
        return none
    places = np.frombuffer(b"".join(rows_["places"]), np.int32).reshape(-1, len(PARTS))
    marks = np.frombuffer(b"".join(rows_["labels"]), np.int8).astype(np.int64)
    weights, bias, start, move = train_field(places, marks, np.concatenate([[0], np.cumsum(rows_["n"])]), len(keys))
    strong = np.abs(weights[:-1]) > 0.05
    field = Field(keys[strong], np.append(weights[:-1][strong], 0.0), bias, start, move, np.zeros(0), rate)
    marks = sample.select("text", "label").mapInArrow(_summarizer(field), "label int, x array<double>").toPandas()
    return field._replace(logistic=fit_logistic(np.array(marks["x"].tolist()), marks["label"].to_numpy(float)))


def _count_parts(batches):
    schema = pa.schema([("part", pa.int64()), ("column", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])
    hasher = WordHasher(words_only=True)
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for first, texts in chunks(same_length_lower(t) for t in strings(batch.column("text"))):
            tokens = tokenize(hasher, texts)
            own = np.repeat(np.arange(len(texts)), np.diff(tokens.texts))
            for column in range(len(PARTS)):
                hashes = tokens.parts[:, column]
                pairs = np.unique(np.column_stack([hashes.view(np.int64), own])[hashes != 0], axis=0)
                if len(pairs):
                    names, place = np.unique(pairs[:, 0], return_inverse=True)
                    mark = labels[first : first + len(texts)][pairs[:, 1]]
                    pos = np.bincount(place, mark, len(names)).astype(np.int64)
                    neg = np.bincount(place, 1 - mark, len(names)).astype(np.int64)
                    yield record_batch(schema, part=names, column=np.full(len(names), column), pos=pos, neg=neg)


def _chain_reader(keys: np.ndarray, bad: np.ndarray):
    """Sentences with a listed part come first, others by hash."""

    def run(batches):
        schema = pa.schema([("draw", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("labels", pa.binary())])
        hasher, lookup, listed = WordHasher(words_only=True), Lookup(keys), Lookup(bad)
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, texts in chunks(same_length_lower(t) for t in strings(batch.column("text"))):
                tokens = tokenize(hasher, texts)
                places = lookup(tokens.parts)
                hit = (listed(tokens.parts) < len(bad)).any(axis=1)
                own = np.repeat(np.arange(len(texts)), np.diff(tokens.texts))
                marks = (hit & (labels[first : first + len(texts)][own] == 1)).astype(np.int8)
                out = {"draw": [], "n": [], "places": [], "labels": []}
                for a, b in zip(tokens.chains, tokens.chains[1:]):
                    some = bool(hit[a:b].any())
                    draw = int(mix(tokens.parts[a:b, 0].sum(keepdims=True))[0]) >> (4 if some else 1)
                    out["draw"].append(draw)
                    out["n"].append(b - a)
                    out["places"].append(places[a:b].tobytes())
                    out["labels"].append(marks[a:b].tobytes())
                    if len(out["n"]) >= 20_000:
                        yield record_batch(schema, **out)
                        out = {name: [] for name in out}
                yield record_batch(schema, **out)

    return run


def _summarizer(field: Field):
    def run(batches):
        schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])
        hasher, lookup = WordHasher(words_only=True), Lookup(field.keys)
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for first, texts in chunks(same_length_lower(t) for t in strings(batch.column("text"))):
                tokens = tokenize(hasher, texts)
                x = summary(field_marginals(field, lookup, tokens), tokens.texts)
                yield record_batch(schema, label=labels[first : first + len(texts)], x=list(x))

    return run


def _scorer(field: Field, schema: pa.Schema, name: str, level: float):
    def spans(p, tokens, k):
        a, b = tokens.texts[k], tokens.texts[k + 1]
        hot = np.flatnonzero(p[a:b] >= level) + a
        out = []
        for i in hot:
            if out and out[-1]["last"] == i - 1:
                out[-1] |= {"last": i, "stop": int(tokens.ends[i]), "score": max(out[-1]["score"], float(p[i]))}
            else:
                out.append({"last": i, "start": int(tokens.begins[i]), "stop": int(tokens.ends[i]), "score": float(p[i])})
        return [{k: v for k, v in s.items() if k != "last"} for s in out]

    def run(batches):
        hasher, lookup = WordHasher(words_only=True), Lookup(field.keys)
        for batch in batches:
            rest = batch.select([n for n in batch.schema.names if n != name])
            for first, texts in chunks(same_length_lower(t) for t in strings(batch.column(name))):
                tokens = tokenize(hasher, texts)
                p = field_marginals(field, lookup, tokens)
                x = summary(p, tokens.texts)
                score = document_scores(field, x)
                own = rest.slice(first, len(texts))
                hot = x[:, 0] >= level
                found = [spans(p, tokens, k) if hot[k] else [] for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score, pa.float64()), pa.array(found, schema.field("spans").type)], schema=schema)

    return run


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", level: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, spans.

    ``spans`` are the runs of words with a marginal of ``level`` at least, as (start, stop) in code
    points of the text, with their largest marginal. Null and empty texts have no spans and the
    score of a text without words. Repeated rows are scored alike; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, score double, spans array<struct<start:int,stop:int,score:double>>"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(_scorer(field, arrow_schema(fields), "_text", level), fields)


def _judge(field: Field):
    """Scores of texts, as a function for ``arrow_udf``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, lookup = WordHasher(words_only=True), Lookup(field.keys)
        for batch in batches:
            found = [np.zeros(0)]
            for _, texts in chunks(same_length_lower(t) for t in strings(batch)):
                tokens = tokenize(hasher, texts)
                found.append(document_scores(field, summary(field_marginals(field, lookup, tokens), tokens.texts)))
            yield pa.array(np.concatenate(found), pa.float64())

    return run


def without_toxic(docs: DataFrame, field: Field, reject: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject``, with all their columns.

    Only the texts go to Python, and only their scores come back.
    """
    judge = F.arrow_udf(_judge(field), "double")
    return docs.filter(judge(F.col(f"`{text}`").cast("string")) < reject)
