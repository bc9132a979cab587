import math
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import topk as T


def brute(rows, k=20, every=20):
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in clean:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=20):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    return sorted(map(tuple, T.top_k(table, F.col("id") % 20 == 0, k).collect()))


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(300, 8, 1)
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_ids(spark):
    rows = [(i, [0.5, 0.25]) for i in range(1, 400)] + vectors(5, 2, 2)[1:] + [(400 + i, [0.5, 0.25 + i % 3]) for i in range(80)]
    rows = [(i + 1000 * (n >= 399), v) for n, (i, v) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 4)
    rows = vectors(200, 4, 3)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(60, 4, 4) + [(None, [1.0] * 4), (100, None), (101, []), (120, [None, 1.0, 1.0, 1.0]), (140, [float("nan")] * 4), (160, [float("inf"), 0.0, 0.0, 0.0]), (180, [1.0, 2.0]), (181, [2.0, 2.0]), (200, [1.0] * 3), (-20, [0.1] * 4)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_large_components_are_exact(spark):
    for spread in (1e3, 1e6):
        rows = vectors(50, 4, 5, spread)
        assert run(spark, rows, 5) == brute(rows, 5)


def test_fewer_candidates_than_k(spark):
    rows = vectors(7, 3, 6)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 6


def test_repeated_ids_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]
    got = run(spark, rows, 2)
    assert [(g[2], g[3]) for g in got] == [(1, 4096), (1, 4096)]


@pytest.mark.parametrize("scale", [1, 64])
def test_quantised_is_the_floor(spark, scale):
    row = spark.createDataFrame([([0.999, -0.001, 1.0],)], "v array<float>").select(T.quantised(F.col("v"), scale)).first()[0]
    assert row == [math.floor(scale * x) for x in (0.999, -0.001, 1.0)]
