"""Benchmark decontamination by SimHash windows.

Documents are read as words (runs of letters and digits, lower case). A window of a document is as
long as a benchmark item. Only windows that share at least one shingle with the benchmark can be
similar to an item at all; each of these gets a 64-bit SimHash of its words, by running sums per
bit. The fingerprints of the items of a length are indexed by blocks of bits, one more than the
radius of that length: two fingerprints within the radius agree in a whole block, so none is
missed. The radius follows from the most words in which a similar window can differ from an item of
that length; all but a few ten thousandths of the similar windows lie within it. Windows beyond it are
looked for by anchors: a similar window holds one of any ``anchors(n)`` shingles of the item, and the
rarest ones are taken. All candidates are verified by the exact weighted Jaccard similarity of
their shingles (weight: occurrences), so no similar window is missed.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.arrow import arrow_schema, strings
from gaugework.llm.rows import packed, quoted, unpacked
from gaugework.llm.words import WordHasher, chunks, shingle_hashes
from gaugework.operators.joins import join_keys
from gaugework.session import stored

WORDS = 5
SIMILARITY = 0.8
SIGMAS = 3.8  # deviations of the distance of fingerprints that a radius allows for
BLOCK_BYTES = 16 << 20  # benchmark text that is broadcast at once


def fingerprints(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash of the windows (start, length) of a sequence of word hashes, each word one vote a bit."""
    out = np.zeros(len(starts), np.uint64)
    total = np.zeros(len(words) + 1, np.int64)
    for bit in range(64):
        np.cumsum(((words >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), out=total[1:])
        ones = total[starts + lengths] - total[starts]
        out |= (2 * ones > lengths).astype(np.uint64) << np.uint64(bit)
    return out


def least_shared(own: int, window: np.ndarray, threshold: float) -> np.ndarray:
    """Shingles that an item of ``own`` shingles and a window must share to be similar."""
    return np.ceil(threshold * (own + window) / (1 + threshold) - 1e-9)


def anchors(own: int, threshold: float) -> int:
    """So many shingles of an item that a similar window, of any size, holds at least one of them."""
    return own - max(math.ceil(threshold * own - 1e-9), 1) + 1


def radius_of(words: int, shingles: int, threshold: float) -> int:
    """Bits in which the fingerprints of an item and of a similar window differ at most, but for rare chance.

    A similar window lacks at most so many shingles of the item, and at an end every changed word
    costs one. With a share ``r`` of the words in common the votes of a bit have correlation ``r``, so
    their signs differ with probability ``acos(r) / pi``.
    """
    changed = shingles - int(least_shared(shingles, np.array([shingles]), threshold)[0])
    odds = math.acos(max(1 - changed / words, 0.0)) / math.pi + 0.5 / math.sqrt(math.tau * words)  # the latter: ties of even votes
    return min(math.ceil(64 * odds + SIGMAS * math.sqrt(64 * odds * (1 - odds))), 32)


class LengthIndex:
    """The items of one number of words, by blocks of their fingerprints and by their anchors."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, rare: list[np.ndarray], radius: int):
        self.items, self.prints, self.radius = items, prints, radius
        names, places = np.concatenate(rare), np.repeat(np.arange(len(items)), [len(r) for r in rare])
        order = np.argsort(names, kind="stable")
        self.anchors, self.anchored = names[order], places[order]
        cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
        self.blocks = []
        for a, b in zip(cuts, cuts[1:]):
            shift, mask = np.uint64(a), np.uint64((1 << (b - a)) - 1)
            values = (prints >> shift) & mask
            order = np.argsort(values, kind="stable")
            self.blocks.append((shift, mask, values[order], order))

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) places, window x items + item, of all pairs within the radius."""
        pairs = []
        for shift, mask, values, order in self.blocks:
            wanted = (windows >> shift) & mask
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = high - low
            at = np.repeat(np.arange(len(windows)), n)
            place = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            near = np.bitwise_count(windows[at] ^ self.prints[place]) <= self.radius
            pairs.append(at[near] * len(self.items) + place[near])
        return np.unique(np.concatenate(pairs))

    def holding(self, hit: np.ndarray, names: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """(window, item) places of all pairs whose window holds an anchor of the item.

        ``names`` are the shingles at the words ``hit``; windows are in order, each has the
        shingles from its start to before its stop, and stops never decrease.
        """
        low, high = np.searchsorted(self.anchors, names, "left"), np.searchsorted(self.anchors, names, "right")
        held = high > low
        hit, low, high = hit[held], low[held], high[held]
        first, last = np.searchsorted(stops, hit, "right"), np.searchsorted(starts, hit, "right")
        inside = last > first
        low, n, first, many = low[inside], (high - low)[inside], first[inside], (last - first)[inside]
        pairs = [np.zeros(0, np.int64)]
        for a, b, w, m in zip(low, n, first, many):
            pairs.append(np.unique((np.arange(w, w + m)[:, None] * len(self.items) + self.anchored[a : a + b]).ravel()))
        return np.unique(np.concatenate(pairs))


class BenchmarkIndex:
    """The items of one broadcast block."""

    def __init__(self, texts: list[str | None], k: int, threshold: float):
        words, bounds = WordHasher(words_only=True)([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
        lengths = np.diff(bounds)
        self.k, self.threshold, self.shingles, self.lengths = k, threshold, {}, {}
        prints = fingerprints(words, bounds[:-1], lengths)
        self.sets: list = [None] * len(texts)
        for n in np.unique(lengths[lengths > 0]):
            items = np.flatnonzero(lengths == n)
            size = min(k, int(n))
            for i in items:
                own, _ = shingle_hashes(words[bounds[i] : bounds[i + 1]], np.array([0, n]), size)
                self.sets[i] = np.unique(own, return_counts=True)
                self.shingles.setdefault(size, []).append(self.sets[i][0])
        known = {size: np.unique(np.concatenate(found), return_counts=True) for size, found in self.shingles.items()}
        self.shingles = {size: names for size, (names, _) in known.items()}
        for n in np.unique(lengths[lengths > 0]):
            items, size = np.flatnonzero(lengths == n), min(k, int(n))
            rare = [self.rarest(i, anchors(int(n) - size + 1, threshold), *known[size]) for i in items]
            self.lengths[int(n)] = LengthIndex(items, prints[items], rare, radius_of(int(n), int(n) - size + 1, threshold))
        self.maybe = {size: np.bincount((s >> np.uint64(42)).astype(np.int64), minlength=1 << 22) > 0 for size, s in self.shingles.items()}

    def rarest(self, item: int, wanted: int, names: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Shingles of an item that stand for ``wanted`` occurrences, those of the fewest items first."""
        own, times = self.sets[item]
        order = np.argsort(used[np.searchsorted(names, own)], kind="stable")
        return own[order[: np.searchsorted(np.cumsum(times[order]), wanted) + 1]]

    def hits(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Places of the shingles that the benchmark has."""
        at = np.flatnonzero(self.maybe[size][(shingles >> np.uint64(42)).astype(np.int64)])
        known = self.shingles[size]
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        return at[known[place] == shingles[at]]

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingles of an item and of a window."""
        names, counts = self.sets[item]
        own, times = np.unique(window, return_counts=True)
        place = np.minimum(np.searchsorted(names, own), len(names) - 1)
        both = np.where(names[place] == own, np.minimum(counts[place], times), 0).sum()
        return float(both / (counts.sum() + times.sum() - both))

    def search(self, words: np.ndarray, bounds: np.ndarray, beyond: bool = True) -> Iterator[tuple[int, int, float, int, int, bool]]:
        """(text, item, similarity, first word, words, whether within the radius) of every similar window of the texts.

        Without ``beyond`` only windows within the radius are looked at.
        """
        for size in self.shingles:
            # a shingle for every word, the last ones of a text cut short and never hit
            shingles, _ = _running(words, bounds, size)
            left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
            hit = self.hits(shingles, size)
            hit = hit[left[hit] >= size]
            if not len(hit):
                continue
            text = np.searchsorted(bounds, hit, "right") - 1
            first, last = bounds[text], bounds[text + 1]
            upto = np.zeros(len(words) + 1, np.int64)
            upto[hit + 1] = 1
            np.cumsum(upto, out=upto)
            for n, index in self.lengths.items():
                if min(n, self.k) != size:
                    continue
                # of each hit the starts of the windows that hold it and no earlier hit of its text
                low = np.maximum(hit - (n - size), first)
                before = np.where(np.append(False, text[1:] == text[:-1]), np.append(0, hit[:-1]) + 1, 0)
                high = np.minimum(hit, np.maximum(last - n, first))
                low = np.maximum(low, before)
                count = np.maximum(high - low + 1, 0)
                starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                owner = np.repeat(text, count)
                lengths = np.minimum(n, bounds[owner + 1] - starts)
                stops = starts + lengths - size + 1
                able = upto[stops] - upto[starts] >= least_shared(n - size + 1, stops - starts, self.threshold)
                if not able.any():
                    continue
                starts, stops, owner, lengths = starts[able], stops[able], owner[able], lengths[able]
                near = index.candidates(_windows(words, bounds, np.unique(owner), owner, starts, lengths))
                far = np.setdiff1d(index.holding(hit, shingles[hit], starts, stops), near, assume_unique=True) if beyond else near[:0]
                for pairs, within in ((near, True), (far, False)):
                    for w, p in zip(pairs // len(index.items), pairs % len(index.items)):
                        a, m = starts[w], lengths[w]
                        value = self.similarity(index.items[p], shingles[a : stops[w]])
                        if value >= self.threshold:
                            yield int(owner[w]), int(index.items[p]), value, int(a - bounds[owner[w]]), int(m), within


def _running(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle that begins at each word, as if all words were one text."""
    found, _ = shingle_hashes(np.concatenate([words, np.zeros(size - 1, np.uint64)]), np.array([0, len(words) + size - 1]), size)
    return found[: len(words)], bounds


def _windows(words, bounds, used, owner, starts, lengths) -> np.ndarray:
    """Fingerprints of windows, summing only over the texts that have some."""
    sizes = (bounds[1:] - bounds[:-1])[used]
    begin = np.cumsum(sizes) - sizes
    part = np.concatenate([words[bounds[t] : bounds[t + 1]] for t in used])
    moved = begin[np.searchsorted(used, owner)] - bounds[owner]
    return fingerprints(part, starts + moved, lengths)


def _searcher(index, ids: list, schema: pa.Schema, beyond: bool):
    def run(batches):
        own, names = pickle.loads(index.value), ids.value
        hasher = WordHasher(words_only=True)
        for batch in batches:
            docs, hashes = batch.column("doc_id"), batch.column("text_hash")
            for first, texts in chunks(t and t.lower() for t in strings(batch.column("text"))):
                best: dict = {}
                for text, item, value, start, n, within in own.search(*hasher(texts), beyond):
                    rank = (value, -start)
                    if (text, item) not in best or rank > best[text, item][0]:
                        best[text, item] = (rank, n, within)
                if best:
                    at = pa.array([first + text for text, _ in best], pa.int64())
                    found = list(best.values())
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs.take(at), hashes.take(at), pa.array([names[i] for _, i in best], schema.field("item_id").type),
                            pa.array([r[0] for r, _, _ in found], pa.float64()), pa.array([-r[1] for r, _, _ in found], pa.int64()),
                            pa.array([n for _, n, _ in found], pa.int64()), pa.array([w for _, _, w in found], pa.bool_()),
                        ],
                        schema=schema,
                    )

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
    beyond: bool = True,
) -> DataFrame:
    """One row per document and item that it holds: doc_id, text_hash, item_id, similarity, start_word, n_words, within_radius.

    ``within_radius`` tells that the fingerprint of that window led to the item; without ``beyond``
    there are no others.

    The best window is given, of equal ones the first. A document shorter than an item is one
    window. Items go to the tasks in blocks of about ``block_bytes``; every block meets all
    documents. Items of fewer than ``words`` words are one shingle, found as a whole; null or empty
    items and documents match nothing. Rows that repeat an id and text give one row; items that
    repeat an id give one row with the best similarity. Other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    fields = f"doc_id {kinds[0]}, text_hash long, item_id {kinds[1]}, similarity double, start_word long, n_words long, within_radius boolean"
    body = quoted(text).cast("string")
    source = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    items = benchmark.select(quoted(item_id).alias("item_id"), quoted(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(math.ceil(size / block_bytes), 1)
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()  # about block_bytes
        # as bytes that hold the class as well: workers need not have the package
        index = spark.sparkContext.broadcast(cloudpickle.dumps(BenchmarkIndex([r["text"] for r in rows], words, similarity)))
        ids = spark.sparkContext.broadcast([r["item_id"] for r in rows])
        part = source.mapInArrow(_searcher(index, ids, arrow_schema(fields), beyond), fields)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("_early"), "n_words", "within_radius")).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best._early")).alias("start_word"), "best.n_words", "best.within_radius"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all their columns stay.

    Rows go by id and text: of rows that repeat an id only those whose text holds an item. Null and
    empty texts stay. Other columns may have any names; an empty table gives an empty result, an
    empty benchmark drops nothing.
    """
    same = ["doc_id", "text_hash"]
    gone = stored(leaks(docs, benchmark, doc_id, text, **options).select(*same).distinct())
    rows = packed(docs, doc_id=quoted(doc_id), text_hash=F.xxhash64(quoted(text).cast("string")))
    return unpacked(join_keys(rows, gone, same, "left_anti"))
