import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    words, hit, found = split(text), set(), set()
    for name, item in items:
        w = split(item)
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(None if name is None else str(name))
    return len(words), len(hit), sorted(found, key=lambda n: (n is None, n or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "it's", "x-y"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([1, 2, 5, 13, 14, 30]) if i > 3 else 40)) for i in range(30)] + [(None, item(15)), (5, item(20)), (90, ""), (91, None), (92, "!!")]
    docs = [item(rng.randint(0, 120)) for _ in range(60)]
    docs += [f"{item(10)}. {t.upper()}! {item(9)}" for _, t in items if t] + [None, "", "?", " ".join([items[0][1]] * 200), "q " * 3000 + items[1][1]]
    docs += [" ".join(items[2][1].split()[:12]), docs[0], docs[0]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return items, docs, benchmark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("most", [D.MAX_BLOCK_WORDS, 400, 25])
def test_equals_brute_force_in_one_block_and_in_many(spark, corpus, most):
    items, docs, benchmark, table = corpus
    assert (len(list(D.compile_blocks(benchmark, max_block_words=most))) > 1) == (most < 500)
    clashing = table.withColumn("found", F.lit("x")).withColumn("name", F.lit("y"))
    rows = D.find_contamination(clashing, benchmark, max_block_words=most).collect()
    assert all((r.row.found, r.row.name) == ("x", "y") for r in rows) and len(rows) == len(docs)
    got = {r.row.doc_id: r.found for r in rows}
    for i, text in enumerate(docs):
        n, hit, found = brute(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (n, hit, found)
        assert sum(s.last - s.first + 1 for s in got[i].spans) == hit


def test_windows_do_not_cross_documents(spark):
    words = " ".join(f"u{i}" for i in range(13))
    benchmark = spark.createDataFrame([(1, words)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(6))), (2, " ".join(f"u{i}" for i in range(6, 13)))], "doc_id long, text string").coalesce(1)
    assert D.find_contamination(docs, benchmark).agg(F.sum("found.n_hit")).first()[0] == 0


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs, corpus):
    rows = D.find_contamination(odd_docs, corpus[2].limit(0)).collect()
    assert len(rows) == odd_docs.count() and all(r.found.n_hit == 0 and r.found.item_ids == [] and r.found.n_words == len(split(r.row.text)) for r in rows)
    rows = D.find_contamination(odd_docs, corpus[2], max_block_words=50).collect()
    assert len(rows) == odd_docs.count() and all(r.found.n_words == len(split(r.row.text)) for r in rows)
    assert D.find_contamination(no_docs, corpus[2]).count() == 0


def test_no_block_is_over_its_bound(spark, corpus):
    items = spark.createDataFrame([("long", " ".join(f"u{i}" for i in range(1000))), ("short", "a b")], "item_id string, text string")
    blocks = list(D.compile_blocks(items, max_block_words=100))
    assert len(blocks) > 10 and all(sum(len(t.patterns) for t in b.tables) <= 100 for b in blocks)
    docs = spark.createDataFrame([(i, " ".join(f"u{k}" for k in range(i, i + 13))) for i in range(0, 990, 7)], "doc_id long, text string")
    rows = D.find_contamination(docs, items, max_block_words=100).collect()
    assert all((r.found.n_hit, r.found.item_ids) == ((13, ["long"]) if r.row.doc_id <= 987 else (0, [])) for r in rows)


def test_long_text_over_several_chunks(spark, monkeypatch):
    text = "a " * 400_000 + " ".join(f"u{i}" for i in range(13))
    benchmark = spark.createDataFrame([(7, " ".join(f"u{i}" for i in range(13)))], "item_id long, text string")
    block = next(iter(D.compile_blocks(benchmark)))
    out = D.search_chunk([None, text, "b"], block)
    assert out["n_hit"].tolist() == [0, 13, 0] and out["item_ids"].tolist() == [[], ["7"], []]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
