"""Phrase collocations from weighted acyclic automata of n-gram counts.

Every task sorts the n-grams it has read, a bounded number at a time, and builds an automaton of their
counts for every prefix range, a stretch of the sorted order. The automata of a range are united,
their weights summed, in rounds that take bounded groups of them. The parts of the candidates are
looked up by composing them with the automata of their ranges.

Phrases of ``n`` words are counted only where their parts can be frequent enough: a candidate's parts
are as frequent as itself. What decides that is a bitmap of a fixed number of bits per level, filled
from all frequent words or pairs; a bit that is set wrongly costs a count, never a phrase.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gaugework.llm.arrow import arrow_schema, key_groups, partitions, record_batch, strings
from gaugework.llm.automata import Automaton, summed, union
from gaugework.llm.words import ALL, BASE, BLOCK_BYTES, WordHasher, mix, powers
from gaugework.session import stored

LEAST = 10
TOP = 2000
PER_CENT = 50
BITS = 26  # of the bitmaps
FLUSH = 1 << 21  # words of one language that a task counts at once; their numbers must fit into 21 bits
RANGE_WORDS = 1 << 20  # words of a language per prefix range, if the ranges suffice
FAN = 64  # ranges that a round tells apart, and automata that it unites at once
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAKS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
UNKNOWN = "und"


class PhraseWords(WordHasher):
    """Words between spaces, tabs and the characters that end a piece."""

    def __init__(self, seed: int):
        self.base = (BASE + 2 * seed * 0xD6E8FEB86659FD93) & ALL
        self.table = BREAKS | np.isin(np.arange(256), [9, 32])
        self._grow(BLOCK_BYTES + 1)

    def _grow(self, n: int) -> None:
        self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)

    def read(self, texts: list[bytes]) -> tuple:
        """Bytes, word starts, ends and hashes of some texts, and which words open a piece."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, ends, hashes = self.block(data)
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(BREAKS[data], out=breaks[1:])
        opens = np.ones(len(starts), bool)
        opens[1:] = breaks[starts[1:]] != breaks[ends[:-1]]
        return data, starts, ends, hashes, opens


def _cuts(data: bytes):
    """A long text in stretches, cut after a character that ends a piece."""
    while len(data) > BLOCK_BYTES:
        cut = max(data.rfind(b, 0, BLOCK_BYTES) for b in (b"\n", b".", b",", b"?", b"!", b";", b":"))
        if cut < 0:
            later = [at for at in (data.find(b, BLOCK_BYTES) for b in (b"\n", b".", b",", b"?", b"!", b";", b":")) if at >= 0]
            cut = min(later, default=len(data) - 1)
        yield data[: cut + 1]
        data = data[cut + 1 :]
    yield data


def _by_language(batches, hasher: PhraseWords):
    """(language, words read) of blocks of about ``BLOCK_BYTES`` of one language."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(strings(batch.column("lang")), strings(batch.column("text"))):
            for piece in _cuts((text or "").encode("utf-8", "surrogatepass").translate(LOWER)):
                held.setdefault(lang, []).append(piece)
                sizes[lang] = sizes.get(lang, 0) + len(piece) + 1
                if sizes[lang] >= BLOCK_BYTES or sum(sizes.values()) >= 16 * BLOCK_BYTES:
                    largest = max(sizes, key=sizes.get)
                    del sizes[largest]
                    yield largest, hasher.read(held.pop(largest))
    for lang, texts in held.items():
        yield lang, hasher.read(texts)


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.append(0, np.cumsum(sizes))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(starts, sizes)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes()))


def _word_counter(schema: pa.Schema, seed: int):
    """Batches (lang, text) to (lang, hash, word, n), words once per language and some million words."""

    def merged(lang: str, parts: list) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _, _ in parts])
        names, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([c for _, c, _ in parts])).astype(np.int64)
        words = pa.concat_arrays([w for _, _, w in parts]).take(pa.array(first))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.view(np.int64)), words, pa.array(n)], schema=schema)

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for lang, (data, starts, ends, hashes, _) in _by_language(batches, PhraseWords(seed)):
            if not len(hashes):
                continue
            names, first, n = np.unique(hashes, return_index=True, return_counts=True)
            held.setdefault(lang, []).append((names, n, _texts(data, starts[first], ends[first])))
            size += len(names)
            if size >= FLUSH // 2:
                for own, parts in held.items():
                    yield merged(own, parts)
                held, size = {}, 0
        for own, parts in held.items():
            yield merged(own, parts)

    return run


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * np.uint64(0x9FB21C651E98DF25) + two)


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of all values of ``hash``: 2 ** BITS / 64 numbers at most reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    word = hashes.select(F.shiftright(place, 6).alias("place"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
    word = word.select("place", F.expr("shiftleft(one, bit)").alias("bits")).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = word.toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def position(one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    """Where a sequence lies in the order that prefix ranges cut: half a word each of its first two labels."""
    high = one & np.uint64(0xFFFFFFFF00000000)
    return high if two is None else high | (two >> np.uint64(32))


def prefix_cuts(words: int, heavy: list[tuple[int, int]], most: int) -> np.ndarray:
    """First positions of the ranges of a language of so many words; ``heavy`` words (hash, count) are cut further."""
    ranges = min(max(math.ceil(words / RANGE_WORDS), 1), most)
    cuts = {k * (1 << 64) // ranges for k in range(ranges)}
    for name, n in heavy:
        parts = max(n * ranges // max(words, 1), 1)
        cuts |= {((name >> 32) << 32) + j * (1 << 32) // parts for j in range(parts)}
    return np.array(sorted(cuts), np.uint64)


def _pieces(schema: pa.Schema, code: int, cuts: np.ndarray, step: int, shard: int, paths: list[np.ndarray], weights: np.ndarray) -> pa.RecordBatch:
    """One automaton per range of sorted sequences."""
    place = np.searchsorted(cuts, position(paths[0], paths[1] if len(paths) > 1 else None), "right") - 1
    place //= step
    order = np.argsort(place, kind="stable")
    names, starts = np.unique(place[order], return_index=True)
    blobs = []
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        at = order[a:b]
        blobs.append(Automaton.build([p[at] for p in paths], weights[at]).pack())
    n = len(names)
    return record_batch(schema, lang=[code] * n, range=names, shard=[shard] * n, blob=blobs)


def _counter(schema: pa.Schema, seed: int, size: int, plan, bitmaps: list, step: int):
    """Batches (lang, text) to automata of the n-grams of ``size`` words whose parts have their bits set."""

    def flush(code: int, cuts: np.ndarray, shard: int, parts: list) -> pa.RecordBatch | None:
        hashes, opens = (np.concatenate(x) for x in zip(*parts))
        good = has(bitmaps[0].value, hashes)
        follows = good[:-1] & good[1:] & ~opens[1:]  # whether words i and i + 1 are a pair
        if size == 3:
            at = np.flatnonzero(follows)
            follows[at] = has(bitmaps[1].value, pair_hash(hashes[at], hashes[at + 1]))
            follows = follows[:-1] & follows[1:]
        first = np.flatnonzero(follows)
        if not len(first):
            return None
        used = np.zeros(len(hashes), bool)
        for k in range(size):
            used[first + k] = True
        names = np.unique(hashes[used])
        key = np.zeros(len(first), np.uint64)
        for k in range(size):
            key = key << np.uint64(21) | np.searchsorted(names, hashes[first + k]).astype(np.uint64)
        keys, n = np.unique(key, return_counts=True)  # sorted as the sequences of hashes
        mask = np.uint64((1 << 21) - 1)
        paths = [names[(keys >> np.uint64(21 * (size - 1 - k)) & mask).astype(np.int64)] for k in range(size)]
        return _pieces(schema, code, cuts, step, shard, paths, n)

    def run(batches):
        known = plan.value
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        shard = TaskContext.get().partitionId() << 32
        blocks = _by_language(batches, PhraseWords(seed))
        while True:
            lang, read = next(blocks, (None, None))
            if lang is not None and len(read[3]):
                for a in range(0, len(read[3]), FLUSH // 2):
                    opens = read[4][a : a + FLUSH // 2 + size - 1].copy()
                    opens[0] = True  # what precedes it in the stretch is another text or already counted
                    held.setdefault(lang, []).append((read[3][a : a + FLUSH // 2 + size - 1], opens))
                sizes[lang] = sizes.get(lang, 0) + len(read[3])
            while sizes and (lang is None or max(sizes.values()) >= FLUSH // 2 or sum(sizes.values()) >= 2 * FLUSH):
                full = max(sizes, key=sizes.get)
                del sizes[full]
                for part in _together(held.pop(full)):
                    shard += 1
                    found = flush(*known[full], shard, part)
                    if found is not None:
                        yield found
            if lang is None:
                return

    return run


def _together(parts: list):
    """Stretches of words, as many as are counted at once."""
    some, size = [], 0
    for part in parts:
        if some and size + len(part[0]) > FLUSH:
            yield some
            some, size = [], 0
        some.append(part)
        size += len(part[0])
    yield some


def _words_to_automata(schema: pa.Schema, plan, step: int):
    """Batches (lang, hash, n) to automata of single words."""

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            hashes, n = batch.column("hash").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            for lang in sorted(set(langs.tolist())):
                own = langs == lang
                shard += 1
                yield _pieces(schema, *plan.value[lang], step, shard, *summed([hashes[own]], n[own]))

    return run


def _uniter(schema: pa.Schema, codes, step: int, least: int):
    """Sorted by (lang, range, part): one union each, cut into the ranges of the next round; light sequences go at the end."""

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for group in key_groups(batches, ["lang", "range", "part"]):
            code = int(group["lang"][0])
            paths, weights = union(group["blob"])
            kept = weights >= least
            if kept.any():
                shard += 1
                yield _pieces(schema, code, codes.value[code], step, shard, [p[kept] for p in paths], weights[kept])

    return run


def _united(shards: DataFrame, codes, rounds: int, least: int) -> DataFrame:
    """(lang, range, shard, blob): one automaton per language and range, of the sequences that weigh ``least`` or more."""
    tasks, fields = partitions(shards.sparkSession), "lang int, range int, shard long, blob binary"
    shards = stored(shards) if rounds > 1 else shards
    for left in range(rounds - 1, -1, -1):
        many = max(math.ceil(shards.select("shard").distinct().count() / FAN), 1) if left else 1
        keys = ["lang", "range", "part"]
        ready = shards.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(many)).cast("int")).repartition(tasks, *keys).sortWithinPartitions(*keys)
        step = FAN ** max(left - 1, 0)
        shards = stored(ready.mapInArrow(_uniter(arrow_schema(fields), codes, step, 1 if left else least), fields))
    return shards


def _sequences(schema: pa.Schema, size: int):
    """Automata to rows (lang, size, h1, h2, h3, n); labels beyond the size are 0."""

    def run(batches):
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("blob")):
                paths, n = Automaton.unpack(blob.as_py()).paths()
                none = np.zeros(len(n), np.int64)
                labels = [p.view(np.int64) for p in paths] + [none] * (3 - size)
                yield record_batch(schema, lang=[lang] * len(n), size=[size] * len(n), h1=labels[0], h2=labels[1], h3=labels[2], n=n)

    return run


def _pair_hashes(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            yield record_batch(schema, hash=pair_hash(h1, h2).view(np.int64))

    return run


def _located(schema: pa.Schema, codes):
    """Batches (lang, size, h1, h2) with the range that holds them."""

    def run(batches):
        for batch in batches:
            langs, sizes = batch.column("lang").to_numpy(), batch.column("size").to_numpy()
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            place = np.zeros(len(langs), np.int64)
            for code in np.unique(langs):
                own = langs == code
                place[own] = np.searchsorted(codes.value[code], position(h1[own], np.where(sizes[own] > 1, h2[own], np.uint64(0))), "right") - 1
            n = len(langs)
            yield record_batch(schema, lang=langs, size=sizes, range=place, kind=[1] * n, h1=batch.column("h1"), h2=batch.column("h2"), blob=[None] * n)

    return run


def _composed(schema: pa.Schema):
    """Sorted by (lang, size, range, kind): an automaton, then the sequences to look up in it."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ("lang", "size", "range", "kind")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                *key, kind = names[:, a].tolist()
                if last != key:
                    last, held = key, None
                if kind == 0:
                    held = Automaton.unpack(batch.column("blob")[a].as_py())
                elif held is not None:
                    wanted = [batch.column(c).slice(a, b - a).to_numpy().view(np.uint64) for c in ("h1", "h2")][: key[1]]
                    yield record_batch(
                        schema, lang=[key[0]] * (b - a), size=[key[1]] * (b - a), h1=batch.column("h1").slice(a, b - a), h2=batch.column("h2").slice(a, b - a), n=held.weights_of(wanted)
                    )

    return run


def _counted_words(source: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(lang, hash, word, n) as the tasks saw them, (lang, hash, n) in all, and the seed under which no two words share a hash."""
    fields = "lang string, hash long, word string, n long"
    for seed in range(16):
        seen = stored(source.mapInArrow(_word_counter(arrow_schema(fields), seed), fields))
        check = F.xxhash64("word")
        words = stored(seen.groupBy("lang", "hash").agg(F.sum("n").alias("n"), (F.min(check) != F.max(check)).alias("shared")))
        if words.filter("shared").isEmpty():
            return seen, words.drop("shared"), seed
    raise ValueError("no seed tells all words apart")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, per_cent: int = PER_CENT
) -> DataFrame:
    """The ``top`` phrases of two or three words per language: lang, rank, phrase, a, l, r, n, score.

    A-Z count in lower case. ``.,;:!?`` and line ends cut a text into pieces, spaces and tabs a piece
    into words; phrases stay within a piece, whole texts are read. Per language ``n`` counts its words
    and ``a``, ``l`` and ``r`` a phrase, its part before and its part after the cut that gives the lowest
    ``score = floor(10^6 a a / (l r))``, of equal ones the first cut. Phrases need ``least`` occurrences;
    a pair goes if a longer phrase that holds it has ``per_cent`` of its occurrences or more. Ranks go
    by score, then ``a``, both falling, then the phrase in byte order, so ties have a fixed order.

    A null language is ``und``. Null and empty texts have no words; repeated rows count as often as they
    are there; other columns are ignored; an empty table gives an empty result. Memory follows one
    piece of text where that is longer than a megabyte. Per language a row reaches the driver.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    seen, words, seed = _counted_words(source)
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    fields = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    if not totals:
        return spark.createDataFrame([], fields)
    rounds = max(math.ceil(math.log(max(sum(totals.values()) / RANGE_WORDS / 4, 1), FAN)), 1)
    most = FAN**rounds
    # words that fill more than one range: at most as many as there are ranges
    share = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(max(v // min(max(math.ceil(v / RANGE_WORDS), 1), most), 1)))])
    heavy: dict = {}
    for row in words.filter(F.col("n") > share[F.col("lang")]).collect():
        heavy.setdefault(row["lang"], []).append((row["hash"] & ALL, row["n"]))
    cuts = {name: prefix_cuts(n, heavy.get(name, []), most) for name, n in totals.items()}
    step = FAN ** (rounds - 1)
    order = sorted(totals)
    plan = spark.sparkContext.broadcast({name: (k, cuts[name]) for k, name in enumerate(order)})
    codes = spark.sparkContext.broadcast([cuts[name] for name in order])

    frequent = words.filter(F.col("n") >= least)
    fields = "lang int, range int, shard long, blob binary"
    shape = arrow_schema(fields)
    singles = _united(stored(frequent.mapInArrow(_words_to_automata(shape, plan, step), fields)), codes, rounds, least)
    bitmaps = [spark.sparkContext.broadcast(_bitmap(frequent))]
    pairs = _united(source.mapInArrow(_counter(shape, seed, 2, plan, bitmaps, step), fields), codes, rounds, least)
    rows = "lang int, size int, h1 long, h2 long, h3 long, n long"
    two = stored(pairs.mapInArrow(_sequences(arrow_schema(rows), 2), rows))
    bitmaps.append(spark.sparkContext.broadcast(_bitmap(two.mapInArrow(_pair_hashes(arrow_schema("hash long")), "hash long"))))
    triples = _united(source.mapInArrow(_counter(shape, seed, 3, plan, bitmaps, step), fields), codes, rounds, least)
    three = stored(triples.mapInArrow(_sequences(arrow_schema(rows), 3), rows))

    # every way to cut a candidate: (size, first label, second label) of both parts
    none = F.lit(0).cast("long")
    part = lambda size, one, two=none: F.struct(F.lit(size).alias("size"), F.col(one).alias("h1"), (F.col(two) if isinstance(two, str) else two).alias("h2"))
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    ways = two.withColumn("cut", F.explode(F.array(cut(1, part(1, "h1"), part(1, "h2"))))).unionByName(
        three.withColumn("cut", F.explode(F.array(cut(1, part(1, "h1"), part(2, "h2", "h3")), cut(2, part(2, "h1", "h2"), part(1, "h3")))))
    )
    ways = stored(ways.select("lang", "size", "h1", "h2", "h3", F.col("n").alias("a"), "cut.k", "cut.left", "cut.right"))
    parts = ways.select("lang", F.explode(F.array("left", "right")).alias("part")).select("lang", "part.*").distinct()
    fields = "lang int, size int, range int, kind int, h1 long, h2 long, blob binary"
    asked = parts.mapInArrow(_located(arrow_schema(fields), codes), fields)
    held = singles.withColumn("size", F.lit(1)).unionByName(pairs.withColumn("size", F.lit(2)))
    held = held.select("lang", "size", "range", F.lit(0).alias("kind"), none.alias("h1"), none.alias("h2"), "blob")
    keys = ["lang", "size", "range"]
    ready = held.unionByName(asked).repartition(tasks, *keys).sortWithinPartitions(*keys, "kind", "h1", "h2")
    fields = "lang int, size int, h1 long, h2 long, n long"
    weights = stored(ready.mapInArrow(_composed(arrow_schema(fields)), fields))

    def with_part(rows: DataFrame, side: str, name: str) -> DataFrame:
        own = weights.select("lang", F.struct("size", "h1", "h2").alias(side), F.col("n").alias(name))
        return rows.join(own, ["lang", side]).drop(side)

    scored = with_part(with_part(ways, "left", "l"), "right", "r")
    score = F.expr("cast((1000000BD * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    scored = scored.groupBy("lang", "size", "h1", "h2", "h3", "a").agg(lowest).select("lang", "size", "h1", "h2", "h3", "a", "low.l", "low.r", "low.score")
    longer = three.select("lang", "n", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("pair"))
    longer = longer.groupBy("lang", "pair.h1", "pair.h2").agg(F.max("n").alias("longest"))
    held_in = scored.filter("size = 2").join(longer, ["lang", "h1", "h2"]).filter(100 * F.col("longest") >= per_cent * F.col("a")).select("lang", "size", "h1", "h2", "h3")
    scored = scored.join(held_in, ["lang", "size", "h1", "h2", "h3"], "left_anti")

    first = F.rank().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc()))
    best = stored(scored.withColumn("place", first).filter(F.col("place") <= top).drop("place"))
    langs = spark.createDataFrame([(k, name, totals[name]) for k, name in enumerate(order)], "lang int, name string, words long")
    best = best.join(F.broadcast(langs), "lang")
    used = best.select("name", F.explode(F.array("h1", "h2", "h3")).alias("hash")).distinct()
    spelt = stored(seen.select(F.col("lang").alias("name"), "hash", "word").join(used, ["name", "hash"], "left_semi").distinct())
    for k in (1, 2, 3):
        best = best.join(spelt.select("name", F.col("hash").alias(f"h{k}"), F.col("word").alias(f"w{k}")), ["name", f"h{k}"], "left" if k == 3 else "inner")
    phrase = F.concat_ws(" ", "w1", "w2", F.when(F.col("size") == 3, F.col("w3")))
    best = best.withColumn("phrase", phrase)
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return best.withColumn("rank", place).filter(F.col("rank") <= top).select(
        F.col("name").alias("lang"), "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
