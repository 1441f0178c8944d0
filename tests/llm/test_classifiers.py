"""Language identification, toxicity and page extraction by held-out accuracy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, pages, toxicity
from tidemark.llm.common import held_out, prepare, sample

MEDIUM = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def medium(spark):
    return prepare(spark).read.parquet(f"{MEDIUM}/documents.parquet")


def test_languages_of_held_out_documents(medium):
    model = langid.fit(medium, langid.Settings(per_language=200, steps=250))
    got = langid.identify(medium.where(held_out(F.col("doc_id"))), model).join(medium.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(r.held_out and 0 <= r.score <= 1 for r in got)


def test_held_out_rows_teach_nothing(medium):
    settings = langid.Settings(per_language=20, steps=5)
    swapped = medium.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(medium, settings), langid.fit(swapped, settings)
    assert a.languages == b.languages and (a.table == b.table).all()


def test_language_of_awkward_rows(awkward, empty):
    model = langid.train(["wort und satz", "the words of it"] * 20, ["de", "en"] * 20, langid.Settings(steps=60))
    got = langid.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 7)} == {"und"} and {r.score for r in got if r.doc_id in (1, 2, 3, 7)} == {0.0}
    assert [r.lang_pred for r in got if r.doc_id == 4] == ["de"]
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(awkward, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_copies_do_not_crowd_the_sample(spark):
    rows = [("a", "hot")] * 4000 + [("a", f"a{i}") for i in range(300)] + [("b", f"b{i}") for i in range(500)] + [("c", "only")] * 3 + [("d", f"d{i}") for i in range(15)]
    for seed in range(12):  # the hot text is drawn with some of them
        got = sample(spark.createDataFrame(rows, "lang string, text string").repartition(3), "lang", 20, seed)
        n = got["lang"].value_counts()
        assert not got.duplicated().any() and n["c"] == 1 and n["d"] == 15 and all(5 <= n[x] <= 40 for x in "ab")
    again = sample(spark.createDataFrame(rows[::-1], "lang string, text string").repartition(7), "lang", 20, seed)
    assert got.equals(again)
    cut = sample(spark.createDataFrame([("a", "x" * 500 + "y"), ("a", "short")], "lang string, text string"), "lang", 20, seed, {"text": 40})
    assert sorted(map(len, cut["text"])) == [5, 40]


def test_every_language_can_be_predicted(spark):
    """More languages than any list of the most frequent ones would have."""
    rows = [(i * 260 + k, f"l{k:03}", " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}zq"] * 30)) for k in range(260) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs, langid.Settings(steps=20))
    assert len(model.languages) == docs.where(~held_out(F.col("doc_id"))).select("lang").distinct().count() > 250


def test_subwords_and_means_loop_by_loop():
    texts = ["Ab, cdé fg", "", None, "x", "one two", "12 34", "longerword"]
    buckets, counts = langid.subwords(texts, 16)
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(1 << 16, 3)).astype(np.float32), rng.normal(size=3), 16)
    want, logits = [], []
    for text in texts:
        own = []
        raw = [c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in (text or "").encode()]
        padded = [32, *raw, 32]
        for size in (3, 4, 5):
            for i in range(len(padded) - size + 1):
                gram = padded[i:i + size]
                if 32 not in gram[1:-1]:  # white space only at the ends
                    key = sum(c << 8 * j for j, c in enumerate(gram)) + (size << 56)
                    own.append((key * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48)
        want.append(sorted(own))
        logits.append(sum((model.table[b].astype(float) for b in own), np.zeros(3)) / max(len(own), 1) + model.bias)
    first = np.cumsum(counts) - counts
    assert [sorted(buckets[a:a + n].tolist()) for a, n in zip(first.tolist(), counts.tolist())] == want
    np.testing.assert_allclose(model.logits(texts), logits, rtol=1e-5)


def test_filters_and_pooling_loop_by_loop():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=(1 << 10, 5)).astype(np.float32), [rng.normal(size=(w, 5, 4)).astype(np.float32) for w in (1, 2, 3)],
                           [rng.normal(size=4).astype(np.float32) for _ in range(3)], rng.normal(size=12), 0.3, 10)
    texts = ["one two three two", "Word", "", None, "the gromblefish, the END", "a " * 30]
    batch = toxicity.Batch(texts, 10)
    got = model.pooled(batch)
    for t, text in enumerate(texts):
        sequence = batch.sequence[batch.starts[t]:batch.ends[t]].tolist()
        vectors = [model.embedding[batch.features[w]].sum(axis=0) if w < len(batch.features) else np.zeros(5) for w in sequence]
        assert len(sequence) == len((text or "").replace(",", "").split()) + 3
        at = 0
        for width, f, b in zip((1, 2, 3), model.filters, model.bias):
            for k in range(4):
                answers = [sum(float(vectors[i + j] @ f[j, :, k]) for j in range(width)) for i in range(len(vectors) - 2)]
                assert got[t, at] == pytest.approx(max(max(answers) + b[k], 0), abs=1e-4)
                at += 1


def test_a_score_does_not_depend_on_the_neighbours():
    texts = [f"some words of text {i} " + ("gromble" if i % 3 == 0 else "and more") for i in range(90)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(90)], ["en"] * 90, 1 / 3)
    together = model.score(texts)
    np.testing.assert_allclose([model.score([t])[0] for t in texts], together, rtol=1e-6)
    np.testing.assert_allclose(model.score(texts[::-1])[::-1], together, rtol=1e-6)


def test_copies_do_not_crowd_the_labelled_sample(spark):
    """One labelled id with 20,000 rows of one text, one text under 3,000 ids, and long texts."""
    rows = [(0, "hot text of one id", "en")] * 20_000 + [(i, "one text of many ids", "en") for i in range(1, 3001)]
    rows += [(i, f"text number {i}", "de") for i in range(4000, 4800)] + [(i, "long " * 10_000 + str(i), "en") for i in range(5000, 5010)]
    labels = [(i, i % 2) for i in [*range(0, 3001), *range(4000, 4800), *range(5000, 5010)]] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    settings = toxicity.Settings(per_label=300)
    got, rate = toxicity.training_rows(docs, known, settings)
    again, _ = toxicity.training_rows(docs.repartition(7), known.orderBy(F.desc("doc_id")).repartition(3), settings)
    assert got.equals(again) and 0.4 < rate < 0.6
    short = got[got["text"].str.len() < settings.longest]  # windows of the long ones may be equal
    assert not short.duplicated(["toxic", "text"]).any() and got["toxic"].nunique() == 2
    assert len(got[got["lang"] == "de"]) > 60 and got["text"].str.len().max() <= settings.longest
    every, _ = toxicity.training_rows(docs, known, toxicity.Settings(per_label=5000))
    held = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).select("doc_id").distinct().collect()}
    assert len(every[every["lang"] == "de"]) == sum(i not in held for i in range(4000, 4800))
    few, _ = toxicity.training_rows(docs, known, toxicity.Settings(per_label=20))
    assert few["toxic"].value_counts().max() <= 40


def test_rejection_is_calibrated():
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(300)]
    model = langid.train(noise, ["x", "y"] * 150, langid.Settings(steps=100))
    assert not model.predict(noise[:50])[2].any()  # languages that cannot be told apart are not accepted


def test_toxic_documents_are_found():
    rng = np.random.default_rng(1)
    common = ["".join(rng.choice(list("aeionrst"), 4)) for _ in range(300)]
    bad = ["gromble", "vexxor", "slagnut"]
    texts, labels = [], []
    for i in range(900):
        words = list(rng.choice(common, 80))
        if i % 3 == 0:
            words[int(rng.integers(80))] = str(rng.choice(bad)) + str(rng.choice(["", "en", "ly"]))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts[:600], labels[:600], [["de", "en"][i % 2] for i in range(600)], 1 / 3)
    predicted = model.score(texts[600:]) >= 0.5
    assert (predicted == np.array(labels[600:], bool)).mean() > 0.97
    assert model.score(["a gromblefish here"])[0] > model.score(["a " + common[0] + " here"])[0]


def test_toxicity_of_english_held_out_documents(medium, spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    model = toxicity.fit(medium, labels)
    rows = toxicity.score_documents(medium.where(held_out(F.col("doc_id"))), model).join(labels, "doc_id").join(medium.select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    clean = [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in clean]) < 0.02  # the labels of this table are noisy: some toxic ones show nothing
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.7


def test_toxicity_of_awkward_rows(awkward, empty, spark):
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 0), (6, 1, None), (7, None, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, labels)
    got = toxicity.score_documents(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns


def test_articles_of_composed_pages():
    field = pages.train(pages.labelled_pages(250, seed=1), epochs=4)
    held = pages.labelled_pages(80, seed=2)
    right = [a == b for blocks, y in held for a, b in zip(field.decode(blocks), y)]
    assert np.mean(right) > 0.97


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(5)
    field = pages.Field(rng.normal(size=(pages._BUCKETS, 2)), rng.normal(size=(2, 2)))
    for blocks, _ in pages.labelled_pages(20, seed=3):
        blocks = blocks[:9]
        e = field.emissions(blocks)
        paths = [[(k >> i) & 1 for i in range(len(blocks))] for k in range(1 << len(blocks))]
        score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:]))
        assert score([int(x) for x in field.decode(blocks)]) == pytest.approx(max(map(score, paths)))


def test_main_text_of_a_page():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><!-- <p>x</p> --><nav><a href=/a>Home</a></nav>
      <div class="ad">Buy this now, it is cheap.</div><article><h1>The &amp; title</h1><p><b>First   line<br>goes on.<p>Second.</p></article>
      <section class="comments"><p>I liked the story a lot, thanks.</p></section><footer>&copy; us</footer>"""
    assert pages.extract(page, pages.trained()) == "The & title First line goes on. Second."


def test_only_raw_text_is_hidden():
    page = """<nav><a href=/a>Home</a></nav><article><h1>The title</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold here.</p>
      <p>A film <object data="f"><param name=a>cannot be shown</object> today.<p>See <svg><title>a wave</title><style>b{}</style><text>up</text><text>down</text></svg> go.</p>
      <script>no</script><p>Some words <svg> more words of the story.</p><p>The last words.</p></article>"""
    want = "The title Let x=2 hold here. A film cannot be shown today. See a wave up down go. Some words more words of the story. The last words."
    assert " ".join(b.text for b in pages.leaves(page)) == "Home " + want
    assert pages.extract(page, pages.trained()) == want
    for tag in ("object", "template", "math", "svg"):
        assert [b.text for b in pages.leaves(f"<article><p>one</p><{tag}><p>two</p>")] == ["one", "two"]
    assert [b.text for b in pages.leaves("<p>one</p><template><p>two</p></template><textarea>x</textarea><p>three</p>")] == ["one", "two", "three"]


def test_deep_nesting_keeps_ancestors():
    page = "<div>" * 120 + "<article>" + "<div>" * 150 + "<p>first" + "</div>" * 150 + "<p>second</p></article><p>third"
    first, second, third = pages.leaves(page)
    assert ("article", "") in first.path and second.path == (("div", ""),) * 120 + (("article", ""), ("p", "")) and third.path == (("div", ""),) * 120 + (("p", ""),)
    assert len(pages.leaves("<div>x" * 50_000 + "</p>" * 50_000)) == 50_000
    buried = "<div>" * 150 + '<div class="sidebar">' + "<div>" * 150 + "<p>words"
    assert ("div", "sidebar") in pages.leaves(buried)[0].path


def test_sums_over_ancestors_as_they_come_and_go():
    rng = np.random.default_rng(7)
    field = pages.Field(rng.normal(size=(pages._BUCKETS, 2)), rng.normal(size=(2, 2)))
    tags = ["<div>", '<div class="side bar">', "<article>", "</article>", "</div>", "<ul><li>", "</ul>", "<p>", "word", "<section id=mainStory>", "</section>"]
    for _ in range(300):
        blocks = pages.leaves("".join(rng.choice(tags, 40)))
        want = [field.weights[list(pages.path_features(b) + pages.text_features(b, i, len(blocks)))].sum(axis=0) for i, b in enumerate(blocks)]
        assert np.allclose(field.emissions(blocks), np.array(want).reshape(-1, 2), atol=1e-9)


def test_quotes_in_tags():
    def texts(page):
        return [b.text for b in pages.leaves(page)]

    assert texts("<p title='a > b'>one<p title=\"it's > it\">two") == ["one", "two"]
    assert texts("<p title=\"open>one</p><p>two") == ["one", "two"]  # no quote closes it, so the first ``>`` ends it
    assert texts('<p title="x') == ['<p title="x'] and texts("a < b > c") == ["a < b > c"] and texts("one<!-- <p>two") == ["one"]
    assert texts('<p ">"x<p ">"y') == ['"x', '"y']  # no ``>`` stands outside of quotes


def test_hostile_pages_take_linear_time():
    field = pages.Field(np.zeros((pages._BUCKETS, 2)), np.zeros((2, 2)))
    for page in ('<p a="' * 150_000, "<p '>\"'\">" * 60_000, "<p" * 300_000 + ">", "<!--" * 200_000, "<script>" * 100_000, "".join(f"<div class=c{i}>x" for i in range(30_000))):
        begun = time.process_time()
        pages.extract(page, field)
        assert time.process_time() - begun < 30


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text only"), (3, "u", "<p>" * 5000), (3, "u", "<article><p>" + "word " * 100_000), (4, "u", "<"), (5, "u", '<a href="x')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    got = pages.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert max(r.n_chars for r in got) == 499_999
    assert pages.main_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())
