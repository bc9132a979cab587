"""Tables with every odd case, shared by the operators' tests."""

import random

import pytest

#: Columns that clash with names that the operators use inside or return.
CLASHING = "fp string, score string, size string, text_hash string, component_id string, p string, found string, id string, key string, rows string, copies string, target string"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(7)
    syllables = ["an", "the", "or", "re", "ion", "é", "ü", "ber", "st", "a"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    base = [sentence(rng.randint(3, 60)) for _ in range(60)]
    near = [t + " " + word() for t in base[:20]]
    odd = [None, "", " ", "\n\t", "a", "A b", "  lead  and  trail ", "日本語 テキスト", "x y", "!!! ???", "word " * 5000, "z" * 30000]
    return base + near + base[:5] + odd


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """doc_id (with nulls and repeats), text, lang, source, n_chars and clashing columns; the last row is repeated."""
    extra = [c.strip().split(" ")[0] for c in CLASHING.split(",")]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1", "s1"][i % 5], len(t) if t else None, *["x"] * len(extra)) for i, t in enumerate(texts)]
    rows += [(None, "null id text here", "en", "s1", 1, *["x"] * len(extra)), (None, None, None, None, None, *["x"] * len(extra)), rows[3], rows[-1]]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
