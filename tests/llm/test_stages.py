"""Stages on awkward rows: repeated ids, clashing column names, workers without the package."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugework.llm import exact, leaks, mixing, near, pages, toxic
from gaugework.session import stored

ODD = "_gone_id int, _rows int, _size int, _nth int, _sha int, mix_copy int, `a.b` int, row int, times int"
ODD_NAMES = ["_gone_id", "_rows", "_size", "_nth", "_sha", "mix_copy", "a.b", "row", "times"]


def odd_docs(spark, rows):
    return spark.createDataFrame([(*r, *range(1, 10)) for r in rows], "doc_id long, text string, source string, " + ODD)


def base(n, seed=""):
    return " ".join(f"{seed}word{i}" for i in range(n))


ROWS = [(1, base(40), "a"), (2, base(40), "a"), (3, base(41), "b"), (4, base(30, "x"), None), (5, None, "a"), (5, "", "b"), (None, base(30, "y"), "b")]


def test_odd_columns_survive_every_stage(spark):
    docs = odd_docs(spark, ROWS)
    bench = spark.createDataFrame([(7, base(30, "x"), 1)], "item_id int, text string, doc_id int")
    for stage, ids in (
        (exact.without_exact_duplicates, [None, 2, 3, 4, 5]),
        (near.without_near_duplicates, [None, 1, 4, 5, 5]),
        (lambda d: leaks.without_leaks(d, bench), [None, 1, 2, 3, 5, 5]),
    ):
        out = stage(docs)
        assert out.columns == docs.columns
        kept = out.collect()
        assert sorted((r["doc_id"] for r in kept), key=str) == sorted(ids, key=str)
        assert all([r[c] for c in ODD_NAMES] == list(range(1, 10)) for r in kept)
        assert stage(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "mix_copy_"]
    assert all([r[c] for c in ODD_NAMES] == list(range(1, 10)) and 1 <= r["mix_copy_"] <= 3 for r in mixed.collect())


def test_near_duplicates_of_repeated_ids_keep_every_unique_text(spark):
    copied = base(60)
    rows = [(1, copied, "a")] + [r for i in range(5, 17) for r in ((i, copied, "a"), (i, base(50, f"u{i}_"), "a"))]
    kept = near.without_near_duplicates(odd_docs(spark, rows)).collect()
    assert len(kept) == 13 and sum(r["text"] == copied for r in kept) == 1
    assert len({r["text"] for r in kept}) == 13


def test_repeated_rows_stay_once(spark):
    rows = [(1, base(20), "a")] * 5 + [(2, base(20), "a"), (3, None, "a"), (3, None, "a")]
    assert near.without_near_duplicates(odd_docs(spark, rows)).count() == 3
    assert sorted(r["doc_id"] for r in exact.without_exact_duplicates(odd_docs(spark, rows)).collect()) == [2, 3]


WORKER = '''
import sys
sys.path.insert(0, {root!r})
import os
os.environ["PYTHONPATH"] = ""
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import gaugework
from gaugework.llm import leaks, lexical, phrases, vectors
words = " ".join("word%d" % i for i in range(30))
docs = spark.createDataFrame([(1, "start " + words + " end", "en"), (2, "nothing here", "en")] + [(9, "salt and pepper", "en")] * 12, "doc_id long, text string, lang string")
bench = spark.createDataFrame([(7, words)], "item_id int, text string")
assert [r["doc_id"] for r in leaks.leaks(docs, bench).collect()] == [1]
assert lexical.search(docs, bench).count() == 1
assert phrases.collocations(docs).count() == 1
vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 50)], "vec_id long, embedding array<double>")
assert vectors.neighbours(vecs, F.col("vec_id") == 20).count() == 20
print("DONE")
'''


def test_workers_need_not_have_the_package(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    (tmp_path / "run.py").write_text(WORKER.format(root=root, shared=f"file://{tmp_path}/shared"))
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": ""})
    assert "DONE" in done.stdout, done.stderr[-3000:]


FORMS = {
    "in a form": ("<form id=aspnetForm><article>{a}</article></form>", "a"),
    "a form as page": ("<form id=aspnetForm><div>{a}{b}</div></form>", "ab"),
    "layout class": ("<div class='site has-sidebar'><article>{a}</article></div>", "a"),
    "class of a sidebar around it": ("<div class='sidebar-right'><article>{a}</article></div>", "a"),
    "siblings": ("{menu}<div>{a}{a}</div><div>{b}{b}</div>{menu}", "aabb"),
    "two articles": ("<article>{a}</article><article>{b}</article>", "ab"),
    "blockquote": ("{menu}<div>{a}<blockquote>{b}</blockquote>{c}</div>{menu}", "abc"),
    "comments": ("<article>{a}</article><div class='comments-area'><article class=comment>{b}</article></div>", "a"),
    "search form": ("<form>find me now</form><div>{a}</div>", "a"),
    "whole-role classes": ("<div class='cookie-banner'>{c}</div><div class='author-info'>{a}</div><div class='related-posts'>{b}</div>", "a"),
}


@pytest.mark.parametrize("name", FORMS)
def test_page_forms(name):
    body, wanted = FORMS[name]
    parts = {k: f"<p>{' '.join([k * 3] * n)}</p>" for k, n in (("a", 60), ("b", 45), ("c", 50))}
    menu = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(8))
    html = f"<html><body><nav><a href=x>Home</a></nav>{body.format(menu=menu, **parts)}<footer>rights</footer></body></html>"
    assert pages.main_text(html) == " ".join(" ".join([k * 3] * {"a": 60, "b": 45, "c": 50}[k]) for k in wanted)


def test_page_without_article_against_plain_steps():
    """Ratio, smoothing and clusters by loops; lines between the first and last content line are the text."""
    import math

    paragraphs = [(f"Item {i}", 3) for i in range(9)] + [(" ".join(["text"] * (30 + 7 * i)), 1) for i in range(8)] + [(f"Foot {i}", 4) for i in range(9)]
    html = "<body><div>" + "".join(f"<p>{'<b></b>' * (tags - 1)}{t}</p>" for t, tags in paragraphs) + "</div></body>"
    ratios = [len(t) / (2 * tags) for t, tags in paragraphs]
    kernel = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    smooth = [sum(kernel[k + 3] * ratios[i + k] for k in range(-3, 4) if 0 <= i + k < len(ratios)) / sum(kernel) for i in range(len(ratios))]
    cut = sum(smooth) / len(smooth)
    for _ in range(60):
        high, low = [s for s in smooth if s >= cut], [s for s in smooth if s < cut]
        cut = (sum(high) / len(high) + sum(low) / len(low)) / 2
    chosen = [i for i, s in enumerate(smooth) if s >= cut]
    wanted = " ".join(t for t, _ in paragraphs[chosen[0] : chosen[-1] + 1])
    assert pages.main_text(html) == wanted and wanted != " ".join(t for t, _ in paragraphs)


def test_toxic_stage_keeps_odd_columns(spark):
    rows = [(i, "you vile rotten scum " * 4 if i % 2 else "a calm and pleasant day " * 4, "a") for i in range(80)]
    docs = odd_docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    field = toxic.fit(docs, labels, F.lit(True))
    out = toxic.without_toxic(docs, field, 0.3)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(range(0, 80, 2))


def test_pipeline_against_planted_rows(spark, tmp_path):
    """Toxic, copied, nearly copied and leaking documents go, all others stay until the mix."""
    import random

    import corpus_pipeline

    draw = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in ("mar", "tel", "so", "vin") for b in ("ka", "lo", "mi") for c in ("n", "st", "re", "d")]
    calm = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows, clean = [], set()
    for i in range(120):
        rows.append((i, calm(60), f"s{i % 3}"))
        clean.add(i)
    for i in range(200, 260):  # toxic
        rows.append((i, " ".join(draw.choice(["you vile rotten scum", "disgusting filthy liar", calm(2)]) for _ in range(15)), "s0"))
    for i in range(300, 310):  # copies: the largest id stays
        rows.append((i, rows[0][1], "s1"))
    clean = clean - {0} | {309}
    for i in range(400, 410):  # near copies: the smallest id stays
        words = rows[1][1].split()
        words[30] = f"other{i}"
        rows.append((i, " ".join(words), "s2"))
    bench = calm(25)
    for i in range(500, 505):  # passages of the benchmark
        rows.append((i, f"{calm(30)} {bench} {calm(20)}", "s1"))
    rows.append((600, None, None))
    clean.add(600)
    draw.shuffle(rows)
    names = "doc_id long, text string, source string"
    spark.createDataFrame(rows, names).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 260)) for i, _, _ in rows if i < 300], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, str(tmp_path)))
    assert docs.columns == ["doc_id", "text", "source"]
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(clean)
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    text = {i: t for i, t, _ in rows}
    assert {r["doc_id"] for r in mixed} <= clean and all(r["text"] == text[r["doc_id"]] for r in mixed)
    sizes, taken = {}, {}
    for i, t, s in rows:
        if i in clean:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    total = sum(sizes.values())
    for source, weight in (("s0", 1), ("s1", 2), ("s2", 3)):  # the null source, without words, weighs 1 and is at its limit of 0
        assert abs(taken[source] - total * weight / 6) <= 60


def plain_rate(sizes, target, limit=3.0):
    """The multiplier by bisection on the sum over single documents."""
    import math

    most, lo, hi = max(sizes), -1e5, 1e5
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(s * min(limit, math.exp(min(mid * s / most, 700))) for s in sizes) < target:
            lo = mid
        else:
            hi = mid
    return {s: min(limit, math.exp(min(lo * s / most, 700))) for s in sizes}


def test_rates_solve_the_dual(spark):
    import random

    draw = random.Random(3)
    docs = [(i, "w " * draw.choice([1, 3, 10, 40, 300]), "abc"[i % 3]) for i in range(400)]
    mix = mixing.entropy_mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for source in "abc":
        own = [r for r in mix if r["source"] == source]
        rates = plain_rate([r["size"] for r in own], own[0]["target"])
        assert all(abs(r["rate"] - rates[r["size"]]) <= 1e-6 for r in own)
        assert len({round(r["rate"], 6) for r in own}) > 1  # tilted by size
        assert all(abs(r["copies"] - r["rate"]) <= 2 for r in own)


def test_fingerprints_find_the_similar_windows(spark):
    import random

    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(draw.randrange(15, 60)))) for i in range(60)]
    docs = []
    for i, text in items:
        w = text.split()
        for k in range(20):
            cut = draw.randrange(0, max(len(w) // 9, 1))
            some = w[cut:] if k % 2 else w[: len(w) - cut]
            docs.append((len(docs), " ".join([word() for _ in range(k)] + some + [word() for _ in range(k)])))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    names = ["doc_id", "item_id", "start_word", "n_words"]
    every = leaks.leaks(docs, bench).select(*names).collect()
    near = set(leaks.leaks(docs, bench, beyond=False).select(*names).collect())
    assert len(every) > 1000 and len(near & set(every)) >= 0.999 * len(every)
