"""Lexical search, nearest vectors and phrases against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import lexical, phrases, vectors
from gaugework.llm.automata import Automaton, union


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def best_documents(docs, items, top=10):
    counted = [(i, terms(t)) for i, t in docs]
    counted = [(i, w) for i, w in counted if w]
    many, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        if t is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, w in counted:
            m = 10 + 90 * len(w) * many // total
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in own if t in w
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture
def library():
    draw = random.Random(4)
    words = ["Ab", "b", "ç", "Ça", "dd", "e9", "x", "ÉÉ", "rare"]
    docs = [(i, " ".join(draw.choice(words[:8]) for _ in range(draw.randrange(1, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,"), (303, "rare " * 40_000), (304, "rare, ab"), (304, "rare, ab"), (None, "rare ab"), (305, "rare-ab")]
    items = [(1, "ab, rare"), (2, "ÉÉ dd x b"), (3, None), (4, "nowhere"), (5, "e9"), (5, "ç"), (6, "")]
    return docs, items


def test_search_equals_brute_force(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical, "SCORED_CELLS", 64)
    names = "doc_id long, text string, term int, `item.x` int, rank int"
    table = spark.createDataFrame([(i, t, 0, 1, 2) for i, t in docs], names).repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id int")
    wanted = best_documents(docs, items)
    for size in (1 << 20, 4):  # one block of items, and several
        rows = lexical.search(table, asked, block_bytes=size).collect()
        assert sorted(map(tuple, rows), key=str) == wanted
    assert lexical.search(table.limit(0), asked).count() == 0
    assert lexical.search(table, asked.limit(0)).count() == 0


def test_search_by_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    found = lexical.search(docs, spark.createDataFrame([("q", "two")], "item_id string, text string")).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["a", "b"] and found[0]["score"] == found[1]["score"]


def nearest(rows, asks, top):
    """Exact nearest rows of the same table, by brute force."""
    out = {}
    for q, v in rows:
        if asks(q):
            near = sorted({(-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q})
            out[q] = [i for _, i in near[:top]]
    return out


def test_vectors_reach_the_wanted_recall(spark):
    draw = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(3000, 24)) * draw.uniform(0.2, 2, (3000, 1)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = vectors.neighbours(table, F.col("vec_id") % 20 == 0, sample_rows=1000, shard_rows=500).collect()
    wanted = nearest(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    assert set(got) == set(wanted) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hits = sum(len({r["vec_id"] for r in got[q].values()} & set(w)) for q, w in wanted.items())
    assert hits >= 0.93 * 20 * len(wanted)
    for q, own in got.items():
        scores = [own[k]["score"] for k in range(1, 21)]
        assert scores == sorted(scores, reverse=True)
        assert math.isclose(scores[0], float(np.dot(rows[q][1], rows[own[1]["vec_id"]][1])), rel_tol=1e-12)


def test_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 2.0, float(i % 3)]) for i in range(120)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [nan, 1.0, 1.0]), (260, [1.0, None, 1.0]), (280, [inf, 1.0, 0.0]), (300, [1.0]), (320, []), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in good + good[:5] + bad], "vec_id long, embedding array<double>, score int, k1 int")
    found = vectors.neighbours(table, F.col("vec_id") % 20 == 0, top=7).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest(good, lambda i: i % 20 == 0, 7)  # ties by the smaller id, copies included
    assert vectors.neighbours(table.limit(0), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.neighbours(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]


def mined(docs, least=10, top=2000):
    n, f = {}, {}
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    rows = {}
    for (lang, g), a in f.items():
        if len(g) == 1 or a < least:
            continue
        longer = [b for (m, h), b in f.items() if m == lang and len(h) == 3 > len(g) and b >= least and g in (h[:2], h[1:])]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(g), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, r, p, -a, left, right, n[lang], -s) for lang, own in rows.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def test_phrases_equal_brute_force(spark, monkeypatch):
    draw = random.Random(8)
    words = ["the", "of", "New", "new", "york", "city", "ß", "é", "x-1", "\x00", "a b"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(draw.choice(words[: draw.choice([4, 11, 71])]) + draw.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n"]) for _ in range(n))
    docs = [(text(draw.randrange(1, 200)), draw.choice(["en", "en", "de", None])) for _ in range(150)]
    docs += [(None, "en"), ("", None), (" .\n", "fr"), ("new york city " * 3000, "en"), ("und yes " * 12, "und")] + [("lock stock barrel", "fr")] * 12
    table = spark.createDataFrame([(t, lang, 1, 2) for t, lang in docs], "text string, lang string, n int, rank int").repartition(5)
    wanted = mined(docs)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in names) for r in phrases.collocations(table).collect()) == wanted
    # several flushes, ranges and rounds of unions
    monkeypatch.setattr(phrases, "FLUSH", 1 << 12)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 256)
    monkeypatch.setattr(phrases, "FAN", 4)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1 << 10)
    assert sorted(tuple(r[c] for c in names) for r in phrases.collocations(table, top=40).collect()) == mined(docs, top=40)
    assert phrases.collocations(table.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_automata(depth):
    draw = np.random.default_rng(depth)
    seen = sorted({tuple(draw.integers(0, 7, depth).tolist()) for _ in range(150)})
    paths, n = [np.array([s[k] for s in seen], np.uint64) for k in range(depth)], draw.integers(1, 3, len(seen)) << 31
    packed = Automaton.build(paths, n).pack()
    back, weights = Automaton.unpack(packed).paths()
    assert all((a == b).all() for a, b in zip(paths, back)) and (weights == n).all()
    known = dict(zip(seen, n.tolist()))
    asked = [tuple(draw.integers(0, 9, depth).tolist()) for _ in range(300)]
    got = Automaton.unpack(packed).weights_of([np.array([s[k] for s in asked], np.uint64) for k in range(depth)])
    assert got.tolist() == [known.get(s, 0) for s in asked]
    odd = [np.array([9], np.uint64)] * depth
    both, total = union([packed, Automaton.build(odd, np.array([5])).pack(), packed], at_once=60)
    assert dict(zip(zip(*[p.tolist() for p in both]), total.tolist())) == {s: 2 * w for s, w in known.items()} | {(9,) * depth: 5}


def test_equal_suffixes_are_one_state():
    paths = [np.array([1, 1, 2, 2], np.uint64), np.array([5, 6, 5, 6], np.uint64)]
    assert [len(b) - 1 for _, _, b in Automaton.build(paths, np.array([3, 4, 3, 4])).levels] == [1, 1]
    assert [len(b) - 1 for _, _, b in Automaton.build(paths, np.array([3, 4, 3, 5])).levels] == [1, 2]
