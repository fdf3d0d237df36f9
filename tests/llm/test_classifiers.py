"""Toxicity, language, quality and licenses: accuracy on documents that weren't learned from, and odd input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from mergeloom.llm import language, licenses, quality, toxicity


def crc(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_of_planted_sentences():
    r = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    text = lambda bad: ". ".join(" ".join(r.choice(words, 8)) + (f" {r.choice(['vile', 'foul'])}" if bad and k == 2 else "") for k in range(6))
    y = np.arange(600) % 5 == 0
    texts = [text(b) for b in y]
    model = toxicity.fit(pa.array(texts[:400]), y[:400])
    p, spans = toxicity.sentence_scores(pa.array(texts[400:]), model, 0.5)
    assert ((p >= 0.5) == y[400:]).mean() > 0.98
    for t, bad, s in zip(texts[400:], y[400:], spans, strict=True):
        if bad and s:
            assert any(w in t[x["start"] : x["end"]] for x in s for w in ("vile", "foul"))
            assert len(s) == 1


def test_toxicity_of_tables(spark, docs, labels, odd, empty):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    marks = spark.createDataFrame([(5, 1), (5, 0), (3, 0), (4, None), (None, 1), (11, 0)], "doc_id long, toxic int")
    assert sorted(r.score for r in toxicity.toxicity(odd, marks).collect() if r.doc_id in (0, 1, 2)) == [0.0, 0.0, 0.0]
    assert toxicity.toxicity(odd, marks.limit(0)).count() == odd.count() and toxicity.toxicity(empty, marks).count() == 0


def test_toxicity_beats_the_majority_on_held_out(docs, labels):
    """On labelled documents that weren't learned from, against always saying clean."""
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in toxicity.toxicity(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([y == p for y, p in held]) >= np.mean([y == 0 for y, _ in held]) and len(held) > 5


def test_noisy_or_is_brute_force():
    """A document's score from its sentences', and the gradient of training against differences of the loss."""
    r = np.random.default_rng(2)
    words = [f"wort{c}" for c in "abcdefgh"]
    texts = [". ".join(" ".join(r.choice(words, 3)) for _ in range(r.integers(1, 5))) for _ in range(30)]
    h = np.unique(np.concatenate([x for *_, found in toxicity.instances(pa.array(words)) for x in found]))
    model = toxicity.Model(h[h != 0], r.normal(size=int((h != 0).sum())), -0.5)
    got, _ = toxicity.sentence_scores(pa.array(texts), model, 2.0)
    weight = dict(zip(model.hashes.tolist(), model.weights, strict=True))
    for text, p in zip(texts, got, strict=True):
        clean = 1.0
        for sentence in text.split(". "):
            z = model.bias
            for w in sentence.split():
                for *_, found in toxicity.instances(pa.array([w])):
                    z += sum(weight.get(int(x[0]), 0.0) for x in found)
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert np.isclose(p, 1 - clean)


def test_language_of_tables(spark, docs, odd, empty):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.language(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    some = {r.doc_id: r for r in language.language(odd).collect()}
    assert some[0].lang_pred == some[1].lang_pred == some[2].lang_pred == "und" and some[0].score == 0.0 and some[5].lang_pred == "en"
    assert language.language(empty).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_forward_backward_is_brute_force(monkeypatch, block):
    """A chain is the whole text, whatever the blocks that it's handled in."""
    from itertools import product

    r = np.random.default_rng(3)
    k, n = 3, 7
    monkeypatch.setattr(language, "BLOCK", block)
    m = language.Model(list("abc"), np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((1, k)), r.normal(size=(k, k)), r.normal(size=k))
    e = r.normal(size=(n + 2, k))
    gamma, pairs, z = language.forward_backward(e, np.array([0, 0, n, n + 2]), m, transitions=True)
    total, want, steps = [], np.zeros_like(e), np.zeros((k, k))
    for first, size in ((0, n), (n, 2)):
        paths = list(product(range(k), repeat=size))
        w = np.exp([m.start[p[0]] + sum(e[first + t, p[t]] for t in range(size)) + sum(m.transitions[p[t], p[t + 1]] for t in range(size - 1)) for p in paths])
        total.append(w.sum())
        for p, x in zip(paths, w / w.sum(), strict=True):
            for t in range(size):
                want[first + t, p[t]] += x
            for t in range(size - 1):
                steps[p[t], p[t + 1]] += x
    assert np.allclose(gamma, want) and np.allclose(pairs, steps) and np.isclose(z, np.log(total).sum())


def test_equal_texts_have_equal_scores(docs):
    """Wherever they are in a batch, and whatever follows them."""
    rows = docs.collect()
    model = language.fit([r.text for r in rows[:80]], [r.lang for r in rows[:80]])
    known = language._text.Weights(model.hashes, model.weights, bits=20)
    long = " ".join(r.text for r in rows[:60])
    for x in (rows[3].text, rows[9].text[:7], long):
        column = pa.array([x, *[r.text for r in rows[:70]], x, "Zz", x, long, x])
        got = language.shares(column, model, known)
        assert (got[[71, 73, 75]] == got[0]).all()


def test_chains_are_whole_texts(docs):
    """A word's marginal depends on words far from it in its text, across blocks."""
    rows = docs.collect()
    model = language.fit([r.text for r in rows], [r.lang for r in rows])
    model.weights[:], model.trigrams[:] = 0, 0  # only the start and the transitions speak
    model.transitions = np.eye(len(model.labels)) * 40.0
    model.start = np.arange(len(model.labels)) * 30.0
    assert all(label == model.labels[-1] and p > 0.99 for _, label, p in language.word_languages("x " * 500, model))


def test_code_switching(docs):
    rows = docs.where("lang in ('en', 'de')").collect()
    model = language.fit([r.text for r in rows], [r.lang for r in rows])
    a, b = (next(r.text for r in rows if r.lang == x and len(r.text.split()) > 60).split()[:30] for x in ("en", "de"))
    got = language.word_languages(" ".join(a + b), model)
    half = sum(len(w) > 0 for w in a)
    assert np.mean([lang == "en" for _, lang, _ in got[: half - 3]]) > 0.8 and np.mean([lang == "de" for _, lang, _ in got[half + 3 :]]) > 0.8
    assert language.fit([], []) is None


def test_quality_of_tables(spark, docs, labels, odd, empty):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and {(r.keep == (r.score >= 0.5)) for r in got} == {True}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right, always = np.mean([r.keep == bool(truth[r.doc_id]) for r in held]), np.mean([truth[r.doc_id] for r in held])
    assert right > max(always, 1 - always)  # than always saying the more common
    marks = spark.createDataFrame([(5, 1), (5, 0), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    assert quality.quality(odd, marks).count() == odd.count() and quality.quality(empty, marks).count() == 0
    assert {r.score for r in quality.quality(odd, marks.limit(0)).collect()} == {0.5}


def test_sites_shrink(spark):
    """Without evidence of their own, a large site's documents get its rate, a small one's nearly the overall rate."""
    rows = [(i, "same text here", "big" if i < 400 else f"s{i}", "p") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(i, int(i % 10 != 0) if i < 400 else i % 2) for i in range(500)], "doc_id long, quality int")
    got = {r.doc_id: r.site for r in quality.quality(docs, marks, held_out=False).collect()}
    rate = sum(int(i % 10 != 0) if i < 400 else i % 2 for i in range(500)) / 500
    assert abs(got[1] - 0.9) < 0.03 and abs(got[401] - rate) < 0.15


def test_licenses(spark, docs, odd, empty):
    corpus = [r.text for r in docs.limit(100).collect()]
    model = licenses.fit(corpus)
    texts = {
        "plain words only": None, "x y\nReleased under the MIT License.\nmore": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Her driver license was revoked. The version 3 of the public library is free.": None,
    }
    got = {r[0]: r for r in licenses.scan_texts(pa.array(list(texts)), model)}
    assert [got[i][1] if i in got else None for i in range(len(texts))] == list(texts.values())
    assert list(texts)[1][got[1][2] : got[1][3]] == "Released under the MIT License"
    found = licenses.license_scan(docs).collect()
    marks = ("All rights reserved.", "Licensed under CC BY-NC 4.0", "Released under the MIT License", "Licensed under the Apache License", "licensed under the GNU General Public License")
    assert {r.doc_id for r in found} == {r.doc_id for r in docs.collect() if any(m in r.text for m in marks)}
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(empty).count() == 0


def test_toxicity_is_fitted_off_the_driver(spark, sf, monkeypatch):
    """The driver gets a model, the same as one fitted on the whole sample, but no texts."""
    from pyspark.sql import DataFrame

    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.select("doc_id", "text").join(labels.groupBy("doc_id").max("toxic").withColumnRenamed("max(toxic)", "toxic"), "doc_id").where("text is not null and toxic is not null").toPandas().sort_values(["doc_id", "text"])
    want = toxicity.fit(pa.array(rows.text), rows.toxic.to_numpy() > 0)
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("texts on the driver"))
    got = toxicity.train(docs, labels)
    assert (got.hashes == want.hashes).all() and (got.weights == want.weights).all() and got.bias == want.bias
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(docs, labels.where("toxic = 0")) is None
