import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, radius=2):
    """Smallest position of each component of the given fingerprints."""
    top = list(range(len(values)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(values))]


@pytest.fixture(scope="module")
def family():
    """Fingerprints in families of near ones, chains among them."""
    rng = random.Random(11)
    out = [0, 1, 3, 7, 15, 31, (1 << 64) - 1, (1 << 64) - 2]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


def test_fingerprints_equal_brute_force(texts):
    for t in texts:
        assert S.fingerprint_of(t) == brute_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_any_two_within_the_radius_agree_on_some_blocks(radius):
    rng, masks = random.Random(1), S.block_masks(radius + 3, radius)
    for _ in range(300):
        x = 0
        for b in rng.sample(range(64), radius):
            x |= 1 << b
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("d", [1, 5, 63, 64, 65, 130])
def test_bit_sliced_distances(radius, d):
    rng = np.random.default_rng(d)
    values = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    values[d:] = np.where(rng.random(300 - d) < 0.5, values[: 300 - d] ^ (np.uint64(1) << rng.integers(0, 64, 300 - d).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300 - d).astype(np.uint64)), values[d:])
    m = 300 - d
    valid = np.packbits(np.pad(np.ones(m, np.uint8), (0, -m % 64)), bitorder="little").view(np.uint64)
    got = S.close_pairs(S.planes_of(values), d, valid, radius)
    want = [i for i in range(m) if bin(int(values[i] ^ values[i + d])).count("1") <= radius]
    assert got.tolist() == want


@pytest.mark.parametrize("radius", [0, 2, 5, 16, 28, 63])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    b = a ^ (rng.integers(0, 1 << 62, 500) & rng.integers(0, 1 << 62, 500) & -(np.arange(500) % 3 > 0).astype(np.int64)).astype(np.uint64)
    assert S.within(a, b, radius).tolist() == [bin(int(x ^ y)).count("1") <= radius for x, y in zip(a, b)]
    assert len(S.within(a[:0], b[:0], radius)) == 0


def test_groups_come_whole():
    rng = np.random.default_rng(1)
    key = np.repeat(np.arange(200), rng.integers(1, 40, 200))
    batches = [pa.RecordBatch.from_pydict({"key": key[a : a + 97]}) for a in range(0, len(key), 97)]
    parts = [x["key"] for x in S.whole_groups(iter(batches), ["key"], 300)]
    assert np.concatenate(parts).tolist() == key.tolist() and len(parts) > 5
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
    assert list(S.whole_groups(iter([]), ["key"])) == []


def test_crowded_groups_are_cut_and_lose_no_link(spark):
    """A family that shares 38 bits and more: the cut groups stay small."""
    rng = random.Random(2)
    stem = rng.getrandbits(64)
    family = sorted({stem ^ sum(1 << b for b in rng.sample(range(26), rng.randint(0, 9))) for _ in range(1500)})
    signed = [v - (1 << 64) if v >> 63 else v for v in family]
    table = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    whole, cut = (S.components(S.links(table, group=g)).collect() for g in (10**9, 50))
    groups = lambda rows: {frozenset(r.node for r in rows if r.label == k) for k in {r.label for r in rows}}
    assert groups(whole) == groups(cut) and len(groups(whole)) >= 1
    assert max(64 - bin(m).count("1") for mask in S.block_masks(5, 2) for m in S._finer(mask, 5, 2)) <= 11


@pytest.mark.parametrize("finish", [S.FINISH_LINKS, 0])
def test_components_equal_brute_force(spark, family, finish):
    """Also when every round of contraction is distributed."""
    signed = [v - (1 << 64) if v >> 63 else v for v in family]
    edges = S.links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3))
    label = {r.node: r.label for r in S.components(edges, finish).collect()}
    want = brute_components(family)
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(w, set()).add(label.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chains_and_hubs(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2, 1), (1, 2)]
    label = {r.node: r.label for r in S.components(spark.createDataFrame(rows, "a long, b long"), 0).collect()}
    assert len({label[i] for i in range(301)}) == 1 and len({label[1000 + i] for i in range(200)}) == 1 and label[0] != label[1000]
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(odd_docs, texts, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    values = [brute_fingerprint(r.text) for r in rows]
    groups = brute_components(values)
    least = {}
    for r, g in zip(rows, groups):
        ids = [x for x in (least.get(g), r.doc_id) if x is not None]
        least[g] = min(ids) if ids else None
    want = sorted(((r.doc_id, f"{v:016x}", least[g]) for r, v, g in zip(rows, values, groups)), key=str)
    out = S.near_duplicates(odd_docs).select("doc_id", S.hex_digits(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, out), key=str) == want
    assert S.near_duplicates(no_docs).count() == 0


def test_drop_keeps_one_row_of_each_component(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    groups = brute_components([brute_fingerprint(r.text) for r in rows])
    out = S.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(set(groups))
    assert S.drop_near_duplicates(no_docs).count() == 0
