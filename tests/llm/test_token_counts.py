import math
import os
import random

from pyspark.sql import functions as F

from siftline.llm import token_counts as T
from siftline.llm.queries import tokenizer_path

VOCABULARY = {" the": -1.0, " th": -2.0, "e": -1.5, " ": -3.0, "t": -2.5, "h": -2.5, "he": -1.2, "re": -1.1, " there": -6.0, " t": -2.2, "r": -2.0}


def brute(word, scores, byte):
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - max(map(len, scores))), end):
            s, n = best[start]
            if word[start:end] in scores:
                options.append((s + scores[word[start:end]], n + 1))
            if end - start == 1:
                size = len(word[start].encode())
                options.append((s + byte * size, n + size))
        top = max(o[0] for o in options)
        best[end] = (top, min(n for s, n in options if s == top))
    return best[len(word)][1]


def counts(counter, words):
    counter.learn(set(words))
    return [counter.known[w] for w in words]


def test_trie_equals_brute_force_and_shares_prefixes():
    counter = T.Counter(VOCABULARY)
    words = ["the", "there", "thee", "t", "éx", "the" * 20, "the" * 100, "日本", "", " ", "  the", "🙂", "a\x00b"]
    assert counts(counter, words) == [brute(" " + w, VOCABULARY, counter.byte) for w in words]
    assert len({w[:i] for w in (" the", " there", " thee", " them") for i in range(1, len(w) + 1)}) == 8
    counter.nodes = 0
    counter.learn({"the", "there", "thee", "them"})
    assert counter.nodes == 8  # a node for each distinct prefix


def test_random_words_equal_brute_force():
    rng, counter = random.Random(3), T.Counter(VOCABULARY)
    words = sorted({"".join(rng.choice("the rx") for _ in range(rng.randint(0, 40))) for _ in range(2000)})
    assert counts(counter, words) == [brute(" " + w, VOCABULARY, counter.byte) for w in words]


def test_very_long_words_take_the_same_trie():
    rng = random.Random(4)
    stem = "".join(rng.choice("there x") for _ in range(30_000))
    words = [stem, stem[:20_000], stem[:20_000] + "zz", "e" * 500, "h" * 256]
    counter = T.Counter(VOCABULARY)
    assert counts(counter, words) == [brute(" " + w, VOCABULARY, counter.byte) for w in words]
    own = sorted(" " + w for w in words)
    shared = sum(len(os.path.commonprefix(pair)) for pair in zip(own, own[1:]))
    assert counter.nodes == sum(map(len, own)) - shared  # a node for each distinct prefix


def test_equals_the_unigram_model_of_the_tokenizers_library():
    from tokenizers import Tokenizer, models

    scores = T.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    known = ["hello", "information", "retrieval", "antidisestablishmentarianism", "zebra", "Straße"]
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], unk_id=0, byte_fallback=False))
    assert counts(T.Counter(scores), known) == [len(model.encode(" " + w).ids) for w in known]


def test_scores_are_normalised_over_the_ranks():
    scores = T.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    assert max(scores.values()) < 0 and 0.9 < sum(map(math.exp, scores.values())) <= 1


def test_pretokens_keep_every_character():
    for text in ("a b", " a  b ", "  ", "a", "x\ny z"):
        assert "".join(" " + p for p in T.pretokens(text)) == " " + text
    assert T.pretokens(None) == T.pretokens("") == []


def test_counts_of_odd_documents_do_not_depend_on_what_is_remembered(spark, odd_docs, no_docs, texts):
    path = tokenizer_path("piece_bpe_32k.model")
    run = lambda most: sorted(odd_docs.select("doc_id", T.count_tokens(path, most)("text").alias("c")).select("doc_id", "c.*").collect(), key=str)
    full = run(T.MAX_KNOWN)
    assert full == run(10) and len(full) == odd_docs.count()
    scores = T.load_vocabulary(path)
    counter = T.Counter(scores)
    expected = {i: sum(brute(" " + w, scores, counter.byte) for w in T.pretokens(t)) for i, t in enumerate(texts) if not t or len(t) < 500}
    got = {r.doc_id: r.n_tokens for r in full}
    assert all(got[i] == n for i, n in expected.items())
    assert no_docs.select(T.count_tokens(path)("text")).count() == 0
    assert odd_docs.select(T.count_tokens(path)(F.lit(None).cast("string")).alias("c")).select("c.n_tokens").distinct().collect()[0][0] == 0
