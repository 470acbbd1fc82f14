"""Language identification, quality classifier and HTML extraction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, language_id, quality_classifier
from tessera.llm.queries import QUERIES


def greedy(text, sample):
    """How many phrases of ``sample`` a text is parsed into, by plain search; a symbol it lacks is a phrase."""
    n, at = 0, 0
    while at < len(text):
        to = at + 1
        while to < len(text) and text[at : to + 1] in sample:
            to += 1
        n, at = n + 1, to
    return n


def test_automaton_parses_like_a_search():
    rng = random.Random(3)
    for _ in range(30):
        sample = bytes(rng.randrange(5) for _ in range(rng.randint(1, 60)))
        text = bytes(rng.randrange(7) for _ in range(50))
        table = language_id.automaton(list(sample), 7)
        rows = np.array([*text, *[7] * 14], dtype=np.uint8).reshape(-1, 8)
        ended, _ = language_id.phrases(language_id.by_step(rows), np.arange(len(rows)) == 0, table)
        assert ended.sum() + 1 == greedy(text, sample)


@pytest.mark.parametrize("lanes", [2, 1 << 14])
def test_costs_equal_a_plain_parse(monkeypatch, lanes):
    monkeypatch.setattr(language_id, "LANES", lanes)
    monkeypatch.setattr(language_id, "SEGMENT", 16)
    rng = random.Random(8)
    sample = {lang: ["".join(rng.choices(letters, k=400)) for _ in range(3)] for lang, letters in {"a": "abcde  ", "b": "cdefgß ", "c": "жзийк ", "d": "日本語文字 ", "e": "abcde  "}.items()}
    model = language_id.Model(sample)
    texts = ["".join(rng.choices("abcdefgß жзий日本x. ", k=rng.choice((1, 3, 15, 16, 17, 40, 200, 700)))) for _ in range(40)]
    texts += [sample["c"][1], sample["a"][0] + sample["b"][2], " ".join(sample["d"]), "日" * 100, "a", None, "", "12 -"]
    held = {lang: b" ".join(map(language_id.cleaned, sample[lang])) for lang in sample}
    for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
            continue
        body = language_id.cleaned(text)
        cost = {x: greedy(body, held[x]) / len(body) for x in sorted(held)}
        best = min(cost, key=cost.get)  # the first of equals
        second = min(v for x, v in cost.items() if x != best)
        assert lang == best and score == pytest.approx(second / (second + cost[best]))


def test_query_equals_a_plain_parse_end_to_end(spark):
    import zlib

    rng = random.Random(12)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(150)] for lang, letters in {"x": "abcdefgh", "y": "efghijkl", "z": "αβγδεζηθ"}.items()}
    docs = [(i, " ".join(rng.choices(words[lang], k=rng.choice((1, 5, 30, 400)))), lang) for i, lang in enumerate(rng.choices("xyz", k=120))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    trained = language_id.sample(df, ~language_id.held_out(F.col("doc_id")))
    pieces = lambda t: [t[k : k + language_id.PIECE] for k in range(0, len(t), language_id.PIECE)]
    allowed = {lang: {p for i, t, x in docs if x == lang and not out(i) for p in pieces(t)} for lang in "xyz"}
    assert all(len(trained[x]) == min(language_id.PIECES, len(allowed[x])) and set(trained[x]) <= allowed[x] and len(set(trained[x])) == len(trained[x]) for x in "xyz")
    held = {lang: b" ".join(map(language_id.cleaned, trained[lang])) for lang in trained}
    got = {r["doc_id"]: r["language"] for r in language_id.identify(df).collect()}
    for i, t, _ in docs:
        body = language_id.cleaned(t)
        cost = {x: greedy(body, held[x]) / len(body) for x in sorted(held)}
        best = min(cost, key=cost.get)
        second = min(v for x, v in cost.items() if x != best)
        assert got[i]["lang_pred"] == best and got[i]["held_out"] == out(i) and got[i]["score"] == pytest.approx(second / (second + cost[best]))


def test_sample_of_hot_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(3_000))
    rows = [(0, "the same hot text of this language, again and again, so that it is a piece of more than a hundred characters in all", "en")] * 400
    rows += [(1, long, "en"), (2, "short", "fr"), (3, long.replace("o", "é"), "de"), *[(i, f"label {i} " * 20, f"l{i}") for i in range(70)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.sample(df, F.lit(True))
    assert len(got) == 73 and got["fr"] == ["short"] and len(got["l5"]) == 1
    each = language_id.ALL_PIECES // 73
    assert len(got["en"]) == len(set(got["en"])) == each and len(got["de"]) == each
    assert any(p in long[language_id.PIECE :] for p in got["en"])


def test_long_texts_are_read_whole():
    model = language_id.Model({"a": ["abc abd abe " * 30], "b": ["xyz xyw xyv " * 30]})
    text = "abc abd " * 40_000
    assert model.predict([text + "xyz xyw " * 80_000])[0][0] == "b" and model.predict([text * 3 + "xyz xyw " * 80_000])[0][0] == "a"
    short = [text[:n] for n in (0, 1, 5, 255, 256, 257, 5000)]
    one = [model.predict([t])[0] for t in short]
    assert model.predict(short) == one and one[0] == ("und", 0.0)
    assert model.predict([None, "123 !?", "\ud83d\ude00"]) == [("und", 0.0)] * 3


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, language string"
    df = spark.createDataFrame([(None, None, None, "x"), (1, "", "en", "x"), (2, "text of words", None, "x"), (3, "the text of the words", "en", "x"), (3, "the text of the words", "en", "x")], schema)
    got = language_id.identify(df).collect()
    assert len(got) == 5 and {r["language"]["lang_pred"] for r in got} == {"und", "en"}
    unlabelled = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["language"]["lang_pred"] for r in unlabelled} == {"und"}
    assert language_id.identify(df.where("false")).count() == 0


def test_ordinal_fit_orders_grades():
    rng = random.Random(1)
    hashed, rows, grades = quality_classifier.Hasher(), [], []
    for _ in range(600):
        g = rng.randrange(4)
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + ["good"] * (g >= 2) + ["better"] * (g == 3) + ["bad"] * (g == 0)
        rows.append(hashed(" ".join(words)))
        grades.append(g)
    f = quality_classifier.fit(rows, np.array(grades), 3)
    assert (np.diff(f.cuts) > 0).all()
    tails = f.tails(f.positions(rows))
    assert (np.diff(tails, axis=1) <= 1e-12).all() and ((tails >= 0) & (tails <= 1)).all()
    mean = [tails.sum(axis=1)[np.array(grades) == g].mean() for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 1.5


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn, test = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    fitted = quality_classifier.learn(docs, quality_classifier.graded(learn))
    rows = quality_classifier.rate(docs.join(test, "doc_id"), fitted).select("quality", "toxic", "rating.kept").collect()
    share = lambda keep: np.mean([r["kept"] for r in rows if keep(r)])
    assert share(lambda r: r["quality"] == 1 and r["toxic"] == 0) >= 0.985
    assert share(lambda r: r["toxic"] == 1) <= 0.25 and share(lambda r: r["quality"] == 0) <= 0.15


def test_classifier_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "x", 0), (1, "good text", 0)], "doc_id bigint, text string, rating int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    fitted = quality_classifier.learn(docs, quality_classifier.graded(none))
    assert quality_classifier.rate(docs, fitted).count() == 3 and quality_classifier.rate(docs.where("false"), fitted).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.learn(docs, quality_classifier.graded(some)).cuts.shape == (2,)


def plain_fit(texts, grades, top):
    """The two passes of the fit, one row and weight at a time: gradients of the mean log-likelihood by their formulas."""
    import math

    q = quality_classifier
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    rows = [sorted(q.Hasher()(t).tolist()) for t in texts]

    def ascend(rows, sparsity, decay):
        dims = sorted({d for r in rows for d in r})
        w, gw = dict.fromkeys(dims, 0.0), dict.fromkeys(dims, 1e-6)
        theta, gt = [-(top - 1) / 2] + [0.0] * (top - 1), [1e-6] * top
        cuts = lambda: [theta[0] + sum(math.exp(x) for x in theta[1 : k + 1]) for k in range(top)]
        for _ in range(q.EPOCHS):
            t, grad, by_cut = cuts(), {d: decay * w[d] for d in dims}, [0.0] * top
            for r, y in zip(rows, grades, strict=True):
                f = sum(w[d] for d in r)
                a = sigmoid(f - t[y - 1]) if y else 1.0
                b = sigmoid(f - t[y]) if y < top else 0.0
                p, da, db = max(a - b, 1e-9), a * (1 - a), b * (1 - b)
                for d in r:
                    grad[d] -= (da - db) / p / len(rows)
                if y:
                    by_cut[y - 1] += da / p / len(rows)
                if y < top:
                    by_cut[y] -= db / p / len(rows)
            for d in dims:
                gw[d] += grad[d] ** 2
                w[d] -= q.RATE * grad[d] / math.sqrt(gw[d])
                w[d] = math.copysign(max(abs(w[d]) - q.RATE * sparsity / math.sqrt(gw[d]), 0.0), w[d])
            for k in range(top):
                g = sum(by_cut[k:]) * (math.exp(theta[k]) if k else 1.0)
                gt[k] += g * g
                theta[k] -= q.RATE * g / math.sqrt(gt[k])
        return w, cuts()

    often = {}
    for r in rows:
        for d in r:
            often[d] = often.get(d, 0) + 1
    w, _ = ascend([[d for d in r if often[d] >= q.LEAST_ROWS] for r in rows], q.SPARSITY, 0.0)
    chosen = {d for d, v in w.items() if v}
    return ascend([[d for d in r if d in chosen] for r in rows], 0.0, q.DECAY)


def test_classifier_equals_a_plain_fit_end_to_end(spark, monkeypatch):
    import math

    monkeypatch.setattr(quality_classifier, "EPOCHS", 40)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(60)}"
    rows = []
    for i in range(90):
        g = rng.randrange(3)
        rows.append((i, " ".join([word() for _ in range(12)] + ["good"] * (g == 2) + ["bad"] * (g == 0)), g))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5, "zzz a greater text of the same id"), (6, None), (None, "x"), (200, "not rated good")], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] + [(7, 2), (999, 1)], "doc_id bigint, grade int")
    grades = [g for _, _, g in rows]
    fitted = quality_classifier.learn(docs, ratings)
    w, cuts = plain_fit([t for _, t, _ in rows], grades, 2)
    assert np.allclose(fitted.cuts, cuts) and fitted.dims.tolist() == sorted(w) and np.allclose(fitted.weights, [w[d] for d in fitted.dims.tolist()])
    for r in quality_classifier.rate(docs.withColumn("rating", F.lit("x")), fitted, keep_from=0.4).collect():
        f = sum(w.get(d, 0.0) for d in quality_classifier.Hasher()(r["text"]).tolist())
        tails = [1 / (1 + math.exp(c - f)) for c in cuts]
        assert r["rating"]["expected_grade"] == pytest.approx(sum(tails)) and r["rating"]["tail"] == pytest.approx(tails[-1]) and r["rating"]["kept"] == (r["rating"]["tail"] >= 0.4)


def test_classifier_of_repeated_and_very_long_rows(spark):
    docs = spark.createDataFrame([(1, "good words " * 100_000), (1, "good words " * 100_000), (2, "bad"), (3, None), (3, "c"), *[(4, "a copy")] * 50], "doc_id bigint, text string")
    fitted = quality_classifier.learn(docs, spark.createDataFrame([(i, i % 3) for i in range(1, 5)], "doc_id bigint, grade int"), sample=3)
    got = quality_classifier.rate(docs, fitted).select("text", "rating.*").collect()
    assert len(got) == 55 and len({(r["text"], r["tail"]) for r in got}) == len({r["text"] for r in got})
    tail = got[0]["tail"]
    kept = quality_classifier.rate(docs, fitted, keep_from=tail).where(F.col("rating.tail") == tail).select("rating.kept").distinct().collect()
    assert [r[0] for r in kept] == [True]


PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld\n  text.<p>Second &#8217;x&#x2019;.</article><footer>&copy; x</footer></body></html>": "Title & more First bold text. Second ’x’.",
    "<script>var a='<p>no</p>'</script><main><p title='a > b'>Yes it is a sentence.</p><!-- <p>no</p> --><style>p{}</style></main>": "Yes it is a sentence.",
    "<header class=site-header>Site</header><div class='content'><p>One long sentence of the story here.</p><div class=\"ad\">Buy now</div><p>Another sentence of the story.</p></div><aside class=sidebar><p>Side note.</p></aside><div id=cookie-notice>We use cookies.</div><form>Name <input></form><section class=comments><p>Nice post!</p></section>": "One long sentence of the story here. Another sentence of the story.",
    "": "", "<p": "", "<!-- open": "", "<script>never closed": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.main_text(page, html_text.field()) == PAGES[page]


def test_field_on_other_labelled_pages():
    field, right, n = html_text.field(), 0, 0
    for page, labels in html_text.labelled_pages(120, 404):
        got = html_text.blocks(page)
        assert len(got) == len(labels)
        right += sum(a == b for a, b in zip(field.decode(got), labels, strict=True))
        n += len(labels)
    assert right >= 0.97 * n


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    field = html_text.Field({"x": 1.0, "y": -0.7}, ((0.3, -0.2), (-0.4, 0.5)), 0.1)
    page = [html_text.Block("t", (f,), []) for f in "xyyxy"]

    def value(labels):
        e = field.emissions(page)
        return sum(x * v for x, v in zip(labels, e, strict=True)) + field.start * labels[0] + sum(field.step[a][b] for a, b in itertools.pairwise(labels))

    best = max(itertools.product((0, 1), repeat=5), key=value)
    assert tuple(field.decode(page)) == best


def test_extract_keeps_articles_whole(spark, tiny):
    import html
    import re

    rows = html_text.extract(spark.read.parquet(f"{tiny}/pages.parquet").withColumn("main_text", F.lit(1))).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r["html"], re.S)[1]
        plain = html.unescape(re.sub(r"</?[a-z][^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner))
        assert r["main_text"] == " ".join(plain.split())
    odd = spark.createDataFrame([(None,), ("",), ("plain",)], "html string")
    assert [r["main_text"] is not None for r in html_text.extract(odd).collect()] == [True] * 3
    assert html_text.extract(odd.where("false")).count() == 0


@pytest.mark.parametrize("depth", [63, 64, 70, 5000])
def test_html_elements_count_at_every_depth(depth):
    text = "Some words are in this sentence, and they go on for a while. Then it ends here."
    page = f'<nav class="main-menu"><p>{text}</nav><div class="advertisement"><p>{text}</p></div><article class="post"><p>One. {text}</p><div class="comments"><p>{text}</p></div></article><p>{text}'
    shallow, deep = (html_text.blocks("<div>" * n + page) for n in (1, depth))
    assert [b.features for b in deep] == [b.features for b in shallow] and len(deep) == 5
    field = html_text.field()
    assert html_text.main_text("<div>" * depth + page, field) == html_text.main_text("<div>" + page, field)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</x>" * 100_000, "<span>" * 100_000 + "</b>" * 100_000, "<b><div>" + "<span>" * 100_000 + "</b>" * 100_000, "<a " * 300_000, "<div>" * 60_000 + "<li>x" * 60_000, "<a " * 200_000 + '=">"', "&#" + "9" * 6000 + "; &#" + "0" * 9000 + "65;"])
def test_a_megabyte_of_odd_markup_takes_seconds(page):
    import time

    began = time.time()
    html_text.main_text(page, html_text.field())
    assert time.time() - began < 10


def test_pages_of_equal_rows_and_very_long_ones(spark):
    body = "<p>A sentence of the story, and one more of them.</p>"
    long = "<article>" + body * 20_000 + "</article>"
    rows = [(long, "a"), (long, "b"), ("<article>" + body, "c"), ("<article>" + body + "<p title='never", "d")]
    got = html_text.extract(spark.createDataFrame(rows, "html string, text string")).orderBy("text").collect()
    one = "A sentence of the story, and one more of them."
    assert [r["main_text"] for r in got] == [" ".join([one] * 20_000)] * 2 + [one] * 2


def test_expected_steps_equal_a_sum_over_all_labellings():
    import itertools
    import math

    rng = random.Random(6)
    for n in (1, 2, 5):
        e = [rng.uniform(-2, 2) for _ in range(n)]
        step = tuple(tuple(rng.uniform(-1, 1) for _ in range(2)) for _ in range(2))
        start = rng.uniform(-1, 1)
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = math.exp(sum(a * v for a, v in zip(y, e, strict=True)) + start * y[0] + sum(step[a][b] for a, b in itertools.pairwise(y)))
        z = sum(weight.values())
        one, steps = html_text._expected(e, step, start)
        assert np.allclose(one, [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)])
        want = [[sum(w * sum((a, b) == p for p in itertools.pairwise(y)) for y, w in weight.items()) / z for b in (0, 1)] for a in (0, 1)]
        assert np.allclose(steps, want)


def test_training_climbs_to_where_the_gradient_is_nought():
    # with the decay, the optimum is where observed and expected counts differ by decay times the weight
    pages = [([html_text.Block("t", (x,), []) for x in xs], list(ys)) for xs, ys in (("aab", (1, 1, 0)), ("ba", (0, 1)), ("ab", (0, 0)), ("bb", (1, 0)), ("a", (1,)))]
    f = html_text.train(pages, epochs=3000, rate=0.05, decay=0.05)
    total = {"a": 0.0, "b": 0.0}
    for blocks, ys in pages:
        one, _ = html_text._expected(f.emissions(blocks), f.step, f.start)
        for block, p, y in zip(blocks, one, ys, strict=True):
            total[block.above[0]] += p - y
    assert all(abs(total[x] + len(pages) * 0.05 * f.weights[x]) < 0.15 for x in total)
