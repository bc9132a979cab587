import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import toxicity as X


@pytest.fixture(scope="module")
def labelled(spark):
    """Ordinary texts, and toxic ones that hold a marker."""
    rng = np.random.default_rng(5)
    words = ["river", "stone", "garden", "window", "paper", "silver", "morning", "table", "green", "letter"]
    rows, marks = [], []
    for i in range(900):
        text = list(rng.choice(words, rng.integers(8, 60)))
        toxic = int(i % 4 == 0)
        for _ in range(max(1, len(text) // 12) * toxic):
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(["grobnak", "vilthum"])))
        rows.append((i, " ".join(text)))
        marks.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(marks, "doc_id long, toxic int")


def brute_model(rows):
    """Kneser-Ney of order 4 over (text, class), with orders 1 and 2 shared, as dictionaries."""
    counts = {c: defaultdict(int) for c in (0, 1)}
    for text, c in rows:
        raw = bytes(int(b) for b in X._bytes(text))
        for i in range(len(raw) - 3):
            counts[c][raw[i : i + 4]] += 1
    lower = lambda grams: {g: len({x for x in grams if x[1:] == g}) for g in {x[1:] for x in grams}}
    orders = {c: {4: counts[c], 3: lower(counts[c])} for c in (0, 1)}
    pairs = lower(set(orders[0][3]) | set(orders[1][3]))
    singles = lower(pairs)
    base = np.array([1.0 + singles.get(bytes([b]), 0) for b in range(256)])
    base /= base.sum()

    def level(own, gram, below):
        own = {g: k for g, k in own.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        return below if not total else max(own.get(gram, 0) - X.DISCOUNT, 0) / total + sum(min(k, X.DISCOUNT) for k in own.values()) / total * below

    def probability(c, gram):
        shared = level(pairs, gram[2:], base[gram[-1]])
        return level(orders[c][4], gram, level(orders[c][3], gram[1:], shared))

    return probability


def test_evidence_equals_brute_force(spark):
    rows = [("the cat sat on the mat", 0), ("a cat is a cat", 0), ("bad cat", 1), ("mat mat", 1)]
    counts = X.count_grams(spark.createDataFrame(rows, "text string, toxic int"))
    model, probability = X._fold(counts.cache()), brute_model(rows)
    for text in ("the bad cat", "mat", "unseen words 123", "", "É"):
        raw = bytes(int(b) for b in X._bytes(text))
        total = sum(math.log(probability(1, raw[i : i + 4]) / probability(0, raw[i : i + 4])) for i in range(len(raw) - 3))
        assert abs(model.evidence(text) - total / (len(raw) - 3 + X.PRIOR_BYTES)) < 1e-5


def part_of(model):
    (part,) = model.parts
    return part.value


def fours(text):
    return np.concatenate(list(X._grams(X._bytes(text))))


def test_many_distinct_grams_do_not_share_weights(spark):
    """More 4-grams than 2^18: each still has its own weights, those that only the other class has seen none."""
    rng = np.random.default_rng(3)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    many, few = [(text(6000), 0) for _ in range(300)], [(text(300).upper() + "0123456789", 1)]
    grams, weight = part_of(X._fold(X.count_grams(spark.createDataFrame(many + few, "text string, toxic int").repartition(4)).cache())).four
    keys = {c: np.unique(np.concatenate([fours(t) for t, k in many + few if k == c])) for c in (0, 1)}
    for c in (0, 1):
        lone = np.setdiff1d(keys[1 - c], keys[c])
        assert len(lone) and (weight[c][grams.find(lone)] == 0).all()
    unseen = np.array([int.from_bytes(f"{i:04}".encode()[::-1]) for i in range(2000, 9000)], np.uint64)
    unseen = unseen[~np.isin(unseen, np.union1d(*keys.values()))]
    assert (grams.slots[grams.find(unseen)] == 0).all()
    assert np.isin(np.union1d(*keys.values()), grams.slots).all() and len(keys[0]) > 300_000


def test_parts_add_up_to_the_whole(spark, monkeypatch, odd_docs):
    rows = [("the cat sat on the mat", 0), ("a cat is a cat", 0), ("bad cat", 1), ("mat mat", 1)]
    counts = X.count_grams(spark.createDataFrame(rows, "text string, toxic int")).cache()
    whole = X._fold(counts)
    monkeypatch.setattr(X, "PART_GRAMS", 9)
    cut = X._fold(counts)
    assert len(whole.parts) == 1 and len(cut.parts) > 3
    assert all(len(p.value.four[0].slots) <= 2 * (9 + X._PAIRS) for p in cut.parts)
    texts = ["the bad cat", "mat", "", "É"]
    assert all(abs(whole.evidence(t) - cut.evidence(t)) < 1e-12 for t in texts)
    few = spark.createDataFrame([(t, "x") for t in [*texts, "mat", None]], "text string, total string")
    values = lambda m: sorted(((r.row.text or "", r.evidence) for r in X.with_evidence(few, m).collect()))
    for (t, a), (u, b) in zip(values(whole), values(cut), strict=True):
        assert t == u and abs(a - b) < 1e-12 and abs(a - whole.evidence(t)) < 1e-12


def test_stretches_do_not_change_the_evidence(spark, monkeypatch):
    counts = X.count_grams(spark.createDataFrame([("the cat sat", 0), ("bad cat", 1)], "text string, toxic int")).cache()
    model, text = X._fold(counts), "the bad cat sat " * 50
    whole = model.evidence(text)
    monkeypatch.setattr(X, "STRETCH", 17)
    assert abs(model.evidence(text) - whole) < 1e-9


def test_held_out_documents_are_told_apart(spark, labelled):
    docs, labels = labelled
    held = docs.join(labels, "doc_id").filter(X.held_out(F.col("doc_id")))
    rows = X.score_toxicity(held, X.fit(docs, labels)).select("row.toxic", F.col("score").alias("s")).collect()
    toxic, ordinary = [r.s for r in rows if r.toxic], [r.s for r in rows if not r.toxic]
    assert np.mean(np.array(toxic) >= 0.5) >= 0.95 and np.mean(np.array(ordinary) >= 0.5) <= 0.02


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, flipped)
    weights = lambda m: [*part_of(m).four[1], *part_of(m).three[1], *part_of(m).contexts[1], *part_of(m).pair_rest, part_of(m).shared]
    assert abs(a.slope - b.slope) < 1e-9 and all((x == y).all() for x, y in zip(weights(a), weights(b), strict=True))


def test_counting_is_the_same_however_texts_are_spread(labelled):
    docs, labels = labelled
    rows = docs.join(labels, "doc_id")
    key = lambda df: sorted(map(tuple, X.count_grams(df).collect()))
    assert key(rows) == key(rows.repartition(7))


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs, labelled):
    docs, labels = labelled
    model = X.fit(docs, labels)
    out = X.score_toxicity(odd_docs, model).select("row.*", F.col("score").alias("s")).drop("score").collect()
    assert out[0].asDict().keys() == set(odd_docs.drop("score").columns) | {"s"}
    assert len(out) == odd_docs.count() and all(0 <= r.s <= 1 for r in out)
    assert len({r.s for r in out if not r.text}) == 1
    assert X.score_toxicity(no_docs, model).count() == 0
    odd_labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    for model in (X.fit(odd_docs, odd_labels), X.fit(no_docs, labels), X.fit(docs, labels.limit(0))):
        assert 0 <= model.score("any text") < 0.5


def test_rows_that_fit_the_curve_are_counted_too(spark, labelled):
    """A word that only toxic rows of remainder 1 hold."""
    docs, labels = labelled
    odd = docs.withColumn("text", F.when((X.id_remainder(F.col("doc_id"), 5) == 1) & (F.col("doc_id") % 4 == 0), F.concat("text", F.lit(" qyxjw"))).otherwise(F.col("text")))
    model = X.fit(odd, labels)
    gram = np.array([int.from_bytes(b"qyxj")], np.uint64)
    grams, weight = part_of(model).four
    assert weight[1][grams.find(gram)][0] > 0 and weight[0][grams.find(gram)][0] == 0


def test_one_repeated_id_does_not_fill_the_curve(spark, labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(X, "CALIBRATION_ROWS", 50)
    seen = []
    monkeypatch.setattr(X, "_logistic", lambda x, y: seen.append(len(x)) or (1.0, 0.0))
    one = next(i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 1)
    more = spark.createDataFrame([(one, f"text {k}") for k in range(400)], docs.schema)
    X.fit(docs.unionByName(more), labels.filter(F.col("doc_id") == one))
    assert seen == [50]
