from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import language as L
from siftline.llm.common import id_remainder, table

SF = "/root/testdata/sf0.01"


def test_grams_are_the_distinct_runs_of_letters():
    text = "Ab, ab!"
    unigrams, bigrams, trigrams = L.grams(text)
    decode = lambda key, n: "".join(chr(key >> 21 * (n - 1 - i) & (1 << 21) - 1) for i in range(n))
    assert {decode(int(g), 2) for g in bigrams} == {" a", "ab", "b "}
    assert {decode(int(g), 3) for g in trigrams} == {" ab", "ab ", "b a"}
    assert {chr(g) for g in unigrams} == {" ", "a", "b"}
    assert L.grams(None) is L.grams("") is L.grams("12 !?") is None


def sets(text):
    return {(n, int(g)) for n, own in enumerate(L.grams(text)) for g in own}


def brute(rows, texts, landmarks):
    """The scores by the definition: kernel of sets, features k(x, landmarks) K^(-1/2), ridge regression for each language."""
    k = lambda x, y: len(sets(x) & sets(y)) / (len(sets(x)) * len(sets(y))) ** 0.5
    gram = np.array([[k(x, y) for y in landmarks] for x in landmarks])
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    features = lambda own: np.c_[np.array([[k(x, y) for y in landmarks] for x in own]) @ root, np.ones(len(own))]
    a, langs = features([t for t, _ in rows]), sorted({lang for _, lang in rows})
    weights = [np.linalg.solve(a.T @ a + L.RIDGE * np.eye(a.shape[1]), a.T @ [lang == own for _, own in rows]) for lang in langs]
    return langs, features(texts) @ np.array(weights).T


def test_prediction_equals_brute_force():
    rows = [("the cat sat", "en"), ("der hund ist da", "de"), ("the dog is here", "en"), ("das ist gut", "de"), ("le chat est la", "fr"), ("a cat is a cat", "en"), ("wo ist der", "de"), ("ou est le", "fr")]
    model = L.Model([(L.grams(t), lang) for t, lang in rows], per_class=2)
    marks = [rows[i][0] for i in (0, 1, 2, 3, 4, 7)]
    texts = ["the hund", "est le chat", "x", "Das da!", "here is a word " * 50]
    langs, scores = brute(rows, texts, marks)
    assert np.allclose(model.scores([L.grams(t) for t in texts]), scores, atol=1e-4)
    expected = [(langs[int(s.argmax())], min(1.0, max(0.0, float(s.max())))) for s in scores]
    for (lang, score), (want, value) in zip(model.predict(texts), expected):
        assert lang == want and abs(score - value) < 1e-4


def test_the_model_is_bounded():
    rows = [(L.grams(f"{a}{b} {b}{a}"), lang) for lang, (a, b) in {"x": "ab", "y": "cd", "z": "ae"}.items()]
    model = L.Model(rows, cells=30)
    assert model.offsets[-1] == 10 and model.table.size <= 30
    full = L.Model(rows)
    held = lambda m, n: {int(x) for x in m.tables[n]}
    assert all(held(model, n) <= held(full, n) for n in range(3)) and {32, ord("a")} <= held(model, 0)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = L.fit(docs.filter(L.not_held_out(F.col("doc_id"))))
    held = docs.filter((id_remainder(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull())
    rows = held.select("lang", L.predict_language(spark, model)("text").alias("p")).select("lang", "p.*").collect()
    real = [r for r in rows if r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in real) >= 0.97 * len(real) and all(0 <= r.score <= 1 for r in rows)


def test_training_rows_are_bounded_and_leave_out_the_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = L.training_rows(docs.filter(L.not_held_out(F.col("doc_id"))), "lang", "text", "doc_id", per_class=20)
    assert set(Counter(k for _, k in rows).values()) == {20}
    key = lambda g: None if g is None else tuple(map(bytes, g))
    kept = {key(L.grams(r.text)) for r in docs.filter(L.not_held_out(F.col("doc_id"))).collect()}
    assert all(key(g) in kept for g, _ in rows)


def test_odd_documents(spark, odd_docs, no_docs, texts):
    model = L.fit(odd_docs)
    out = {r.doc_id: r.p for r in odd_docs.select("doc_id", L.predict_language(spark, model)("text").alias("p")).collect()}
    for i, t in enumerate(texts):
        assert (out[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    empty = L.fit(no_docs)
    assert {r.p.lang_pred for r in odd_docs.select(L.predict_language(spark, empty)("text").alias("p")).collect()} == {"und"}
    assert no_docs.select(L.predict_language(spark, model)("text")).count() == 0


def test_every_language_is_learned(spark):
    """However many there are."""
    rows = [(i, f"text {i} word", f"l{i % 500}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = L.training_rows(docs, "lang", "text", "doc_id")
    assert {lang for _, lang in found} == {f"l{i}" for i in range(500)} and len(found) == 1000
    assert len(L.fit(docs).langs) == 500


def test_rows_that_share_an_id_are_sampled_one_by_one(spark):
    for i in range(6):
        rows = [(i, f"the text of number {k} is this", "en") for k in range(5000)] + [(100 + k, f"der text {k} ist da", "de") for k in range(50)]
        rows += [(7, "le texte est ici", "fr")] * 3000  # alike: one row
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
        found = Counter(lang for _, lang in L.training_rows(docs, "lang", "text", "doc_id", per_class=30))
        assert found == {"en": 30, "de": 30, "fr": 1}
