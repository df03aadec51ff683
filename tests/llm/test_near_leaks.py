"""Near duplicates and benchmark windows against brute force."""

import random

from gaugework.llm import graph, leaks, near


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    n = len(texts)
    linked = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *[label[j] for j in linked[i]]]) for i in range(n)]
        if new == label:
            break
        label = new
    return [(label[i], len(linked[i]), len(sets[i]), label[i] == i) for i in range(n)]


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcde") for _ in range(4))
    bases = [[word() for _ in range(n)] for n in (40, 60, 80, 200)]
    texts = []
    for i in range(160):
        w = list(bases[i % 4])
        for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
            w[draw.randrange(len(w))] = word()
        texts.append(" ".join(w))
    passage = " ".join(bases[0])
    texts += [passage + " " + " ".join(word() for _ in range(80)) for _ in range(30)]  # alike in part only
    return texts + ["", None, " \n", "one two", "One  TWO", "x" * 3000, passage.upper()]


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    names = ["class_id", "n_links", "n_shingles", "kept"]
    wanted = brute(texts)
    found = [tuple(r[n] for n in names) for r in near.near_duplicates(docs).orderBy("doc_id").collect()]
    assert found == wanted
    # small leaves and blocks: splits, and comparisons block by block
    monkeypatch.setattr(near, "BLOCK_SETS", 8)
    split = [tuple(r[n] for n in names) for r in near.near_duplicates(docs, leaf=4).orderBy("doc_id").collect()]
    assert split == wanted
    kept = near.without_near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, r in enumerate(wanted) if r[3]] and kept[0].__fields__ == ["doc_id", "text", "row"]


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "A b C"), (None, None)], "doc_id long, text string")
    rows = near.near_duplicates(docs).collect()
    assert sorted((r["n_links"], r["kept"]) for r in rows) == [(0, True), (2, False), (2, False), (2, True)]
    assert near.near_duplicates(docs.limit(0)).count() == 0
    assert near.without_near_duplicates(docs).count() == 2


def test_runs_needed_by_simulation():
    draw, missed, pairs = random.Random(5), 1e-3, 60_000
    runs, agreement = near.runs_needed(0.8, missed), near.least_agreement(0.8, missed / 2)

    def meet(agree, used, splits):  # whether a leaf below a shared node is shared
        if not splits:
            return True
        fresh: list = []
        while len(fresh) < near.CHILDREN:
            i = draw.randrange(near.COORDINATES)
            if i not in used and i not in fresh:
                fresh.append(i)
        return any(agree[i] and meet(agree, (*used, i), splits - 1) for i in fresh)

    lost = 0
    for _ in range(pairs):
        agree = [draw.random() < 0.8 for _ in range(near.COORDINATES)]
        lost += sum(agree) < agreement or not any(agree[i] and meet(agree, (i,), 20) for i in range(runs))
    assert lost / pairs <= 1.4 * missed  # three standard errors above


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 104)}}


def test_leaks(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (30, 45, 3, 12)]
    noise = lambda n: [word() for _ in range(n)]
    edited = list(items[1])
    edited[0], edited[-1] = "changed", "too"
    texts = [
        " ".join(noise(50) + items[0] + noise(20)),
        " ".join(noise(5) + edited + noise(9)).upper(),
        " ".join(noise(8) + items[0][:15] + noise(8)),
        ", ".join(noise(3) + items[2] + noise(3)),
        " ".join(items[3][:-1]),
        " ".join(noise(300)), "", None,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id int, text string")
    for block in (1 << 20, 200):  # one block of items, and several
        rows = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 6), r["start_word"], r["n_words"]) for r in leaks.leaks(docs, bench, block_bytes=block).collect()}
        assert rows == {(0, 0): (1.0, 50, 30), (1, 1): (round(39 / 43, 6), 4, 45), (3, 2): (1.0, 3, 3), (4, 3): (0.875, 0, 11)}
    assert sorted(r["doc_id"] for r in leaks.without_leaks(docs, bench).collect()) == [2, 5, 6, 7]
    assert leaks.leaks(docs.limit(0), bench).count() == 0 and leaks.leaks(docs, bench.limit(0)).count() == 0


def windows_alike(doc, item):
    """(similarity, first word, words) of the best of all windows of a document of different words."""
    n = min(len(doc), len(item))
    own, best = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}, (0, 0, 0)
    for a in range(len(doc) - n + 1):
        window = {tuple(doc[i : i + 5]) for i in range(a, a + n - 4)}
        best = max(best, (len(own & window) / len(own | window), -a, n))
    return best


def test_shortened_items_at_any_hamming_distance():
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    items = [[word() for _ in range(draw.randrange(15, 60))] for _ in range(2400)]
    index = leaks.BenchmarkIndex([" ".join(w) for w in items], leaks.WORDS, leaks.SIMILARITY)
    texts = []
    for i, item in enumerate(items):  # shortened by 10 and by 20 %, alone and inside other words
        cut = item[: len(item) - round(len(item) * (0.1, 0.2)[i % 2])]
        texts.append(cut if i % 4 < 2 else [word() for _ in range(9)] + cut + [word() for _ in range(30)])
    wanted = {(i, i): windows_alike(t, items[i]) for i, t in enumerate(texts)}
    wanted = {pair: found for pair, found in wanted.items() if found[0] >= leaks.SIMILARITY}
    best: dict = {}
    near = set()
    for text, item, value, start, n, within in index.search(*leaks.WordHasher(words_only=True)([" ".join(t).encode() for t in texts])):
        best[text, item] = max(best.get((text, item), (0, 0, 0)), (value, -start, n))
        near |= {(text, item)} if within else set()
    assert best == wanted and len(wanted) > 800
    assert len(near) >= 0.999 * len(wanted)
