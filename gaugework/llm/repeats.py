"""Repeated byte strings by external induced sorting of the suffixes that can repeat.

Every window of ``LENGTH`` bytes has an anchor: its leftmost 64-byte string of least hash. Equal
windows have equal anchors at equal places, so only anchors that occur twice are looked at, and a
window is looked at once, at its own anchor. The contexts of these anchors are the suffix tuples.
They are dealt by anchor and sorted by what follows the anchor, by Spark's sorter, which spills to
disk; neighbours get their common-prefix lengths. The ranks of the suffixes that begin one byte
earlier are induced from the ranks of those before, byte by byte to the left: a suffix ``d`` bytes
ahead of the anchor repeats if another one has the same ``d`` bytes ahead and a common prefix of
``LENGTH - d`` behind. Anchors with many contexts are dealt over several tasks; what is alone
in its task meets the others' by fingerprint.

Equal texts are found first by the tree-merge; one of them stands for all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.arrow import arrow_schema, key_groups, partitions, record_batch
from gaugework.llm.exact import tree_merge
from gaugework.llm.words import WordHasher, mix
from gaugework.operators.joins import join_hot
from gaugework.session import stored

LENGTH = 400
GRAM = 64
BLOCK = 1 << 20
GROUP = 8192  # contexts of one anchor that one task takes
BATCH = 4096  # contexts that are induced together
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def slices(batch: pa.RecordBatch, rows: int = 128):
    """A batch a few rows at a time, so that few texts are Python objects at once."""
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


class Anchors:
    """The anchors of texts with the first and last window that each stands for."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.reach = length, gram, length - gram + 1
        self.hasher = WordHasher()

    def windows(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its anchor's place, and the hashes by place; at most ``BLOCK`` bytes."""
        up, down = self.hasher.up, self.hasher.down
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        n = len(data) - self.gram + 1
        hashes = mix((total[self.gram :] - total[:n]) * down[:n])
        low = np.uint64(BLOCK - 1)
        keys = (hashes & ~low) | np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost
        w = self.reach
        padded = np.full(-(-n // w) * w, ~np.uint64(0))
        padded[:n] = keys
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
        return (best & low).astype(np.int64), hashes

    def of_block(self, texts: list[bytes]):
        """(text, hash, place, first window, last window) arrays of texts that fit into a block."""
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        place, hashes = self.windows(data)
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
        inside = np.arange(len(place)) + self.length <= (begin + sizes)[owner]
        at = np.flatnonzero(inside)
        if not len(at):
            return [np.zeros(0, np.int64)] * 5
        mine = place[at]
        turn = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)))
        last = at[np.append(turn[1:], len(at)) - 1]
        first, anchor, text = at[turn], mine[turn], owner[at[turn]]
        return text, hashes[anchor].view(np.int64), anchor - begin[text], first - begin[text], last - begin[text]

    def of_texts(self, texts: list[bytes]):
        """Lists of (hash, place, first, last) per text."""
        out: list[list] = [[] for _ in texts]
        held, names, shifts, size = [], [], [], 0

        def flush():
            for t, h, p, a, b in zip(*[x.tolist() for x in self.of_block(held)]):
                s, own = shifts[t], out[names[t]]
                if own and own[-1][1] == p + s and own[-1][3] + 1 >= a + s:  # cut between two pieces
                    own[-1] = (h, p + s, own[-1][2], max(own[-1][3], b + s))
                else:
                    own.append((h, p + s, a + s, b + s))

        for name, text in enumerate(texts):
            for a in range(0, max(len(text) - self.length + 1, 1), BLOCK - self.length + 1):
                piece = text[a : a + BLOCK]
                if held and size + len(piece) > BLOCK:
                    flush()
                    held, names, shifts, size = [], [], [], 0
                held.append(piece)
                names.append(name)
                shifts.append(a)
                size += len(piece)
        if size >= self.length:
            flush()
        return out


def _anchor_reader(schema: pa.Schema, length: int, gram: int):
    def run(batches):
        anchors = Anchors(length, gram)
        for batch in batches:
            for part in slices(batch):
                found = anchors.of_texts(part.column("body").to_pylist())
                lists = [[dict(zip(("hash", "place", "first", "last"), x)) for x in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(lists, schema.field("anchors").type)], schema=schema)

    return run


def _context_reader(schema: pa.Schema, length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out: dict = {f.name: [] for f in schema}
                for key, body, anchors in zip(*[part.column(c).to_pylist() for c in ("key", "body", "anchors")]):
                    for x in anchors:
                        place, first, last = x["place"], x["first"], x["last"]
                        values = (x["hash"], x["bucket"], x["buckets"], key, place, first, last, body[first:place], body[place : last + length])
                        for name, value in zip(out, values):
                            out[name].append(value)
                    if len(out["hash"]) >= 4096:
                        yield record_batch(schema, **out)
                        out = {name: [] for name in out}
                yield record_batch(schema, **out)

    return run


def _matrix(pieces: list[bytes], width: int, from_end: bool) -> np.ndarray:
    """Bytes as rows of 16-bit values, -1 beyond their end; ``from_end``: the last byte comes first."""
    out = np.full((len(pieces), width), -1, np.int16)
    sizes = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    row = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, (sizes[row] - 1 - at) if from_end else at] = flat
    return out


def induced(group: np.ndarray, left: list[bytes], right: list[bytes], length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the window that begins d bytes ahead of a context's anchor occurs in another context.

    Contexts are sorted by ``group``, then by ``right``. Gives two tables, context x d: the window
    repeats; it is the first of its class (d beyond a context's windows: neither).
    """
    m = len(group)
    behind = _matrix(right, length, False)
    ahead = _matrix(left, reach - 1, True) if reach > 1 else np.zeros((m, 0), np.int16)
    differ = (behind[1:] != behind[:-1]) | (behind[1:] < 0)
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[group[1:] != group[:-1]] = -1
    most = np.array([len(x) for x in left])
    least = length - np.array([len(x) for x in right])
    repeats, first = np.zeros((m, reach), bool), np.zeros((m, reach), bool)
    rank = np.unique(group, return_inverse=True)[1].astype(np.int64)  # of the bytes ahead, group included
    alive = np.arange(m)
    for d in range(reach):
        if d:
            alive = alive[most[alive] >= d]
            if not len(alive):
                break
            _, place = np.unique(rank[alive] * 256 + ahead[alive, d - 1], return_inverse=True)
            rank[alive] = place
        run = np.concatenate([[0], np.cumsum(common < length - d)])
        here = alive[least[alive] <= d]
        if len(here):
            _, at, place, count = np.unique(rank[here] * (m + 1) + run[here], return_index=True, return_inverse=True, return_counts=True)
            repeats[here, d] = count[place] > 1
            first[here[at], d] = True
    return repeats, first


def _spans(place: int, marked: np.ndarray, length: int):
    """(start, stop) of the bytes that the windows at the marked distances cover."""
    starts = place - np.flatnonzero(marked)[::-1]
    cut = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return zip(starts[cut].tolist(), (starts[np.append(cut[1:], len(starts)) - 1] + length).tolist())


def _inducer(schema: pa.Schema, length: int, gram: int):
    """Spans of repeated windows; for anchors dealt over buckets also the windows that others must see."""
    reach = length - gram + 1

    def prints(parts: list[bytes], hasher: WordHasher) -> np.ndarray:
        """Fingerprints of byte strings of ``length``."""
        data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, length).astype(np.uint64) + np.uint64(1)
        return mix(data @ hasher.up[:length])

    def settle(held, hasher):
        group = np.repeat(np.arange(len(held)), [len(g["key"]) for g in held])
        left = [x for g in held for x in g["lead"]]
        right = [x for g in held for x in g["rest"]]
        keys = [x for g in held for x in g["key"]]
        places = [x for g in held for x in g["place"]]
        repeats, first = induced(group, left, right, length, reach)
        out = {f.name: [] for f in schema}

        def add(**values):
            for name in out:
                out[name].append(values.get(name))

        for i in np.flatnonzero(repeats.any(axis=1)):
            for a, b in _spans(places[i], repeats[i], length):
                add(key=keys[i], start=a, stop=b)
        at = 0
        for g in held:
            n, buckets = len(g["key"]), int(g["buckets"][0])
            if buckets > 1:
                row, d = np.nonzero(first[at : at + n])
                row = row + at
                if len(row):
                    seen = np.concatenate(
                        [prints([(left[i] + right[i])[len(left[i]) - k :][:length] for i, k in zip(row[a : a + 4096], d[a : a + 4096])], hasher) for a in range(0, len(row), 4096)]
                    )
                    part = (seen % np.uint64(buckets)).astype(np.int64)
                    for p in range(buckets):
                        mine = np.flatnonzero(part == p)
                        if len(mine):
                            owner = b"".join(keys[i] for i in row[mine])
                            starts = np.array([places[i] for i in row[mine]], np.int32) - d[mine].astype(np.int32)
                            add(hash=int(g["hash"][0]), part=p, prints=seen[mine].tobytes(), owners=owner, starts=starts.tobytes())
            at += n
        return record_batch(schema, **out)

    def run(batches):
        hasher = WordHasher()
        held, size = [], 0
        for g in key_groups(batches, ["hash", "bucket"]):
            held.append(g)
            size += len(g["key"])
            if size >= BATCH:
                yield settle(held, hasher)
                held, size = [], 0
        if held:
            yield settle(held, hasher)

    return run


def _meeting(schema: pa.Schema, length: int):
    """Windows of one anchor that were alone in their buckets and have an equal in another one."""

    def run(batches):
        for g in key_groups(batches, ["hash", "part"]):
            seen = np.frombuffer(b"".join(g["prints"]), np.uint64)
            owners, starts = b"".join(g["owners"]), np.frombuffer(b"".join(g["starts"]), np.int32)
            _, place, count = np.unique(seen, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[place] > 1)
            if len(again):
                yield record_batch(schema, key=[owners[16 * i : 16 * i + 16] for i in again], start=starts[again], stop=starts[again] + length)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (start, stop) spans that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cutter(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out: dict = {f.name: [] for f in schema}
                for key, body, spans in zip(*[part.column(c).to_pylist() for c in ("key", "body", "spans")]):
                    runs = merged([(s["start"], s["stop"]) for s in spans])
                    kept, at = hashlib.sha256(), 0
                    for a, b in runs:
                        kept.update(body[at:a])
                        at = b
                    kept.update(body[at:])
                    out["key"].append(key)
                    out["removed"].append([{"start": a, "stop": b} for a, b in runs])
                    out["kept_sha256"].append(kept.hexdigest())
                yield record_batch(schema, **out)

    return run


def repeated_anchors(each: DataFrame) -> DataFrame:
    """The anchors of ``each`` whose hash occurs at two places, one row per hash, key and place.

    Neither the join nor the grouping after it brings the rows of one hash together.
    """
    spot = F.xxhash64("key", "place")
    twice = stored(each.groupBy("hash").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).filter("low < high").select("hash"))
    return join_hot(each, twice, "hash").groupBy("hash", "key", "place").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def dealt_anchors(members: DataFrame, group: int) -> DataFrame:
    """``members`` with ``buckets``, so that ``group`` rows of a hash meet in each, and their ``bucket``."""
    counts = stored(members.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("buckets")))
    bucket = F.pmod(F.xxhash64("key", "place"), F.col("buckets")).cast("int")
    return join_hot(members, counts, "hash").withColumn("bucket", bucket)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else in
    the table. ``removed`` lists the maximal runs as (start, stop) in bytes of the UTF-8 text. A
    null text is empty; texts shorter than ``length`` stay whole. Rows that repeat an id and a text
    are occurrences of their own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    whole = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("sha", F.sha2("body", 256))
    whole = whole.withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    narrow = whole.select("key", "sha", F.octet_length("body").cast("long").alias("n_bytes"), F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("member"))
    narrow = stored(tree_merge(narrow, ["key"], "member"))

    long = whole.filter(F.octet_length("body") >= length).select("key", "body")
    fields = "key binary, anchors array<struct<hash:long,place:int,first:int,last:int>>"
    anchors = stored(long.mapInArrow(_anchor_reader(arrow_schema(fields), length, gram), fields))
    each = anchors.select("key", F.explode("anchors").alias("a")).select("key", "a.*")
    members = stored(repeated_anchors(each))
    entry = F.struct("hash", "bucket", "buckets", "place", "first", "last")
    lists = dealt_anchors(members, group).groupBy("key").agg(F.collect_list(entry).alias("anchors"))
    chosen = lists.join(narrow.filter("member.row = winner.row").select("key", "member.doc_id"), "key").withColumnsRenamed({"key": "_key", "doc_id": "_id"})
    texts = whole.select("doc_id", "key", "body").join(chosen, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = stored(texts.select("key", "body", "anchors").dropDuplicates(["key"]))

    fields = "hash long, bucket int, buckets int, key binary, place int, first int, last int, lead binary, rest binary"
    contexts = texts.mapInArrow(_context_reader(arrow_schema(fields), length), fields)
    contexts = contexts.repartition(tasks, "hash", "bucket").sortWithinPartitions("hash", "bucket", "rest")
    fields = "key binary, start int, stop int, hash long, part int, prints binary, owners binary, starts binary"
    found = stored(contexts.mapInArrow(_inducer(arrow_schema(fields), length, gram), fields))
    fields = "key binary, start int, stop int"
    spans = found.filter("part IS NULL").select("key", "start", "stop")
    apart = found.filter("part IS NOT NULL").select("hash", "part", "prints", "owners", "starts").repartition(tasks, "hash", "part").sortWithinPartitions("hash", "part")
    spans = spans.unionByName(apart.mapInArrow(_meeting(arrow_schema(fields), length), fields))

    runs = spans.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    fields = "key binary, removed array<struct<start:int,stop:int>>, kept_sha256 string"
    cut = texts.select("key", "body").join(runs, F.col("key") == F.col("_key")).select("key", "body", "spans")
    cut = stored(cut.mapInArrow(_cutter(arrow_schema(fields)), fields)).withColumnsRenamed({"key": "_key"})

    copied = (F.col("members") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    same = narrow.filter(copied).select("member.doc_id", "n_bytes", all_of_it.alias("removed"), F.lit(EMPTY_SHA).alias("kept_sha256"))
    rest = narrow.filter(~copied).join(cut, (F.col("key") == F.col("_key")) & (F.col("n_bytes") >= length), "left")
    rest = rest.select("member.doc_id", "n_bytes", F.coalesce("removed", none).alias("removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return same.unionByName(rest).select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", "removed")
