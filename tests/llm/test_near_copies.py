import random

import numpy as np
import pytest

import corpus_pipeline
from siftline.llm import near_copies as N
from siftline.llm import simhash as S


def brute_groups(texts):
    """Smallest position of each component of pairs with Jaccard >= 0.8 over five-word shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    top = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top[i], top[j]))
                top = [x if t == y else t for t in top]
    return top


@pytest.fixture(scope="module")
def copies():
    """Families of edited copies, chains among them, common lines, equal texts and odd ones."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(vocabulary, k=12))
    out = [None, "", " \n", "one", "One", "a b c"]
    for _ in range(20):
        text = rng.choices(vocabulary, k=rng.randint(5, 150))
        for _ in range(8):
            out.append(" ".join(text) + (f" {line}" if rng.random() < 0.3 else ""))
            for _ in range(rng.randint(0, 3)):  # the next copy is of this one
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return out


def test_stage_keeps_one_of_each_component(spark, copies):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(5)
    want = sorted(set(brute_groups(copies)))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want
    assert len(want) < len(set(S.fingerprint_of(t) for t in copies))


def test_pairs_across_components_are_found(spark, copies, monkeypatch):
    """Also where no set is similar to the smallest key of its tokens."""
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(N, "_stars", lambda groups, sets: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == sorted(set(brute_groups(copies)))


def test_hot_shingles_are_grouped_alike(spark, copies, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(3)
    common = spark.sparkContext.broadcast(N._frequencies(docs, "text"))
    signatures, found = N._signatures(docs, "doc_id", "text", common), []
    for hot in (0, 1, 10**9):
        monkeypatch.setattr(N, "HOT", hot)
        found.append(sorted(map(tuple, N._groups(signatures, common).distinct().collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    sets = {}
    for r in signatures.collect():
        for i, t in enumerate(r.prefix):
            sets.setdefault(t, set()).add((i, r.key))
    assert found[0] == sorted((t, *x, *min(own)) for t, own in sets.items() for x in own if x != min(own))


def test_one_family_gives_few_pairs(spark, monkeypatch):
    """Copies of one original, most pairs of which are under 0.8."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    original = rng.choices(vocabulary, k=140)
    out = []
    for _ in range(400):
        text = list(original)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(140)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(4)
    sizes, across = [], N._across
    monkeypatch.setattr(N, "_across", lambda *a: sizes.append(a) or across(*a))
    monkeypatch.setattr(N, "HOT", 4)
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == sorted(set(brute_groups(out)))
    assert across(*sizes[0]).count() < 400 * 20


def test_tiles_lose_no_pair(spark, copies, monkeypatch):
    """Groups cut into tiles of two sets."""
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(N, "_stars", lambda groups, sets: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(N._across, "__defaults__", (2,))
    assert sorted(r.doc_id for r in N.drop_near_copies(docs).collect()) == sorted(set(brute_groups(copies)))


def test_similar_sets_are_within_the_radius():
    """Pairs just at 0.8, of any size: the radius is not what loses one."""
    rng = np.random.default_rng(6)
    most = 0
    for n in [5] * 3000 + [9, 10, 18, 45, 90, 450] * 300:
        a = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        same = -(-4 * n // 5) if n < 9 else n - n // 9  # one less, or as many replaced as 0.8 bears
        b = a[:same] if n < 9 else np.concatenate([a[:same], rng.integers(0, 1 << 63, n - same, np.int64).astype(np.uint64) * np.uint64(2)])
        assert N.similar(np.unique(a), np.unique(b))
        most = max(most, bin(S.fingerprint_from(a) ^ S.fingerprint_from(b)).count("1"))
    assert most <= N.RADIUS


def test_odd_documents(odd_docs, no_docs):
    out = N.drop_near_copies(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == len(set(brute_groups([r.text for r in odd_docs.select("text").collect()])))
    assert N.drop_near_copies(no_docs).count() == 0


def test_frequencies_count_every_text(spark, copies):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(3)
    want = np.zeros(1 << N.BUCKET_BITS, np.int64)
    for t in copies:
        np.add.at(want, N._bucket(N.shingle_set(t)), 1)
    assert (N._frequencies(docs, "text") == want).all() and want.sum() > 1000
    assert not N._frequencies(docs.limit(0), "text").any()
