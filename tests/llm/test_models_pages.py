"""Trained scores on held-out rows, marginals by enumeration, page extraction, the pipeline's shape."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugework.llm import language, pages, quality, queries, toxic

FOLDER = "/root/testdata/sf0.01"


def accuracy(rows, labels, name):
    known = {r["doc_id"]: r[name] for r in labels.collect() if r[name] is not None}
    pairs = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return sum(a == b for a, b in pairs) / len(pairs)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_trees", "quality", 0.93), ("op4_toxic_field", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, spark.read.parquet(f"{FOLDER}/labels.parquet"), label) >= least


def test_held_out_languages(spark):
    rows = queries.QUERIES["op10_language"](spark, FOLDER).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pairs = [(r["lang_pred"], lang[r["doc_id"]]) for r in rows if r["held_out"]]
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.97


def test_marginals_by_enumeration():
    draw = np.random.default_rng(4)
    odds, start, move = np.exp(draw.normal(size=9)), np.exp(draw.normal(size=2)), np.exp(draw.normal(size=(2, 2)))
    bounds = np.array([0, 4, 5, 9])
    wanted = np.zeros(9)
    for a, b in zip(bounds, bounds[1:]):
        total = 0.0
        for states in itertools.product((0, 1), repeat=b - a):
            w = start[states[0]] * np.prod([odds[a + i] if s else 1.0 for i, s in enumerate(states)]) * np.prod([move[s, t] for s, t in zip(states, states[1:])])
            total += w
            wanted[a:b] += w * np.array(states)
        wanted[a:b] /= total
    assert np.allclose(toxic.Chains(bounds).marginals(odds, start, move), wanted)


def test_toxic_spans_and_odd_rows(spark):
    clean = [(i, f"the {i} quiet river runs past stone {i * 7} and field", 0) for i in range(60)]
    bad = [(100 + i, f"the {i} quiet grobian runs past stone {i * 3} and field", 1) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in clean + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in clean + bad], "doc_id long, toxic int")
    field = toxic.fit(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, "Ünd, GROBIAN!", 1.0), (2, "quiet river", 2.0), (3, "", 3.0), (None, None, None), (2, "quiet river", 2.0)], "doc_id long, text string, score double")
    rows = {r["doc_id"]: r for r in toxic.score(odd, field).collect()}
    assert rows[1]["score"] > 0.5 > rows[2]["score"] and [(s["start"], s["stop"]) for s in rows[1]["spans"]] == [(5, 12)]
    assert rows[3]["spans"] == [] and rows[None]["score"] == rows[3]["score"] < 0.5
    left = toxic.without_toxic(odd, field)
    assert left.columns == ["doc_id", "text", "score"] and left.count() == 4
    none = toxic.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxic.score(odd, none).collect()} == {0.0}


def test_a_repeated_id_is_fitted_on_once(spark, monkeypatch):
    rows = [(i, f"the {i} quiet {('river', 'grobian')[i % 2]} runs past stone", i % 2) for i in range(80)]
    labels = spark.createDataFrame([(i, x, x) for i, _, x in rows], "doc_id long, toxic int, quality int")
    grown, fitted = [], []
    monkeypatch.setattr(quality, "grow", lambda x, y, old=quality.grow: (grown.append(len(y)), old(x, y))[1])
    monkeypatch.setattr(toxic, "fit_logistic", lambda x, y, old=toxic.fit_logistic: (fitted.append(len(y)), old(x, y))[1])
    docs = spark.createDataFrame([r[:2] for r in rows + rows[:1] * 300], "doc_id long, text string")
    assert quality.quality(docs, labels, F.lit(True)).count() == 380
    toxic.fit(docs, labels, F.lit(True))
    assert grown == [80] and fitted == [80]


def test_trees_learn_a_step_and_survive_one_kind():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 3))
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 1)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert np.allclose(quality.grow(x, np.ones(3000)).scores(x[:5]), 1, atol=1e-5)
    assert np.allclose(quality.grow(x[:0], y[:0]).scores(x[:5]), 0.5)


def test_statistics_of_odd_texts():
    rows = quality.Statistician()([b"", b"a", b"one two\none two\n", "É| 9%\n\n".encode(), b"w " * 40_000])
    assert rows.shape == (5, len(quality.STATISTICS)) and np.isfinite(rows).all() and not rows[0].any()
    of = dict(zip(quality.STATISTICS, rows[2]))
    assert of["unique_words"] == 0.5 and of["unique_lines"] == 0.5 and of["top_word"] == 0.5 and of["word_length"] == 3


def test_language_of_odd_texts(spark):
    samples = [("xx", b"lorem ipsum dolor " * 20), ("yy", b"quick brown foxes " * 20)]
    docs = spark.createDataFrame([(1, "quick foxes brown"), (2, None), (3, "12 - 34"), (4, ""), (5, "Ipsum"), (5, "Ipsum")], "doc_id long, text string")
    rows = language.languages(docs, samples).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["yy", "und", "und", "und", "xx", "xx"]
    assert {r["doc_id"] for r in rows if r["rejected"]} == {2, 3, 4, 5}  # one word is too little to tell
    narrow = language.languages(docs, samples, narrow=1.1).orderBy("doc_id").collect()
    assert all(r["rejected"] for r in narrow) and [r["lang_pred"] for r in narrow] == [r["lang_pred"] for r in rows]
    other = language.languages(spark.createDataFrame([(1, "½ ² Ⅷ")], "doc_id long, text string"), samples).first()
    assert (other["lang_pred"], other["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in language.languages(docs, []).collect()} == {"und"}


def test_pages():
    text = pages.main_text
    assert text(None) == text("") == text("<html><script>var a='<p>no</p>'</script></html>") == ""
    page = (
        "<html><head><title>no</title></head><body><nav><a href=x>no</a></nav><div class='cookie-notice'>no</div>"
        "<div id=main><h1>Head &amp;\n line</h1><p>One <b>two</b><i>three</i><br>four <p>Short.<ul><li>a<li>b</ul>"
        + "<p>" + "A longer run of plain words fills this paragraph. " * 4 + "</div>"
        "<section class='user comments'><p>no</p></section><form>no</form><footer>no</footer>"
    )
    assert text(page) == "Head & line One twothree four Short. a b " + " ".join(["A longer run of plain words fills this paragraph."] * 4)
    assert text("plain &lt;text&gt; &#233;") == "plain <text> é"
    assert text("<article><p>x</p></article><aside>" + "no " * 900 + "</aside>") == "x"
    assert text("<article>" + "<p>" * 3000 + "deep</article>") == "deep"


def test_pages_of_a_table(spark):
    frame = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (2, None, "<p>a\xa0b", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(frame).collect()) == [(1, "", 0), (1, "", 0), (2, "a b", 3)]
    assert pages.extract(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (4, "", "en", "s", 0), (4, "g h", "en", "t", 3)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "mixing"]
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, FOLDER)
            if name != "mixing":
                assert now.columns == docs.columns
        assert now.columns == [*docs.columns, "mix_copy"]
        assert now.count() <= 3 * start.count()
