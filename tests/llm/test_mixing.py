import re

from pyspark.sql import functions as F

from siftline.llm import mixing as M


def brute_targets(sizes):
    """Water-filling over {source: size}, in fractions."""
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in sizes if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / rest for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, mixed):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size_of(r.text)
    want = brute_targets(sizes)
    got = mixed.collect()
    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((r.doc_id, size_of(r.text))) for r in rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        largest = max([r.size for r in own], default=0)
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= largest + 1e-6
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)


def test_odd_documents_meet_their_targets_through_many_leaves(odd_docs):
    for leaf, fan in ((512, 256), (3, 2)):
        check(odd_docs, M.mix(odd_docs, leaf_docs=leaf, fan_in=fan))


def test_reruns_agree_whatever_the_partitions(odd_docs):
    key = lambda df: sorted(map(str, df.select("doc_id", "row_hash", "copies").collect()))
    assert key(M.mix(odd_docs)) == key(M.mix(odd_docs.repartition(7)))


def test_many_sources_and_excess_is_reshared(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 23:02d}") for i in range(400)] + [(1000 + i, "w " * 500, "big") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = M.mix(docs, leaf_docs=8, fan_in=4)
    check(docs, mixed)
    assert mixed.filter("target = 3 * source_size").count() > 0


def test_transfers_keep_the_words_and_the_expectations():
    p, q, a, b = 0.3, 0.6, 5, 8
    up, down = min(1 - p, b / a * q), min(p, b / a * (1 - q))
    for draw in (0.01, 0.99):
        x, y = M.pivot(p, a, q, b, draw)
        assert abs(x * a + y * b - (p * a + q * b)) < 1e-9 and (x in (0, 1) or y in (0, 1))
    chance = down / (up + down)
    high, low = M.pivot(p, a, q, b, 0.0), M.pivot(p, a, q, b, 0.999999)
    assert abs(chance * high[0] + (1 - chance) * low[0] - p) < 1e-9 and abs(chance * high[1] + (1 - chance) * low[1] - q) < 1e-9


def test_empty_table_and_documents_without_words(spark, no_docs):
    assert M.mix(no_docs).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " ", None)], "doc_id long, text string, source string")
    assert {(r.size, r.taken, r.target) for r in M.mix(docs).collect()} == {(0, 0, 0.0)}


def test_repeat_documents_keeps_columns_and_counts(odd_docs):
    mixed = M.mix(odd_docs)
    out = M.repeat_documents(odd_docs, mixed)
    assert out.columns == odd_docs.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_long_documents_are_made_up_for_by_shorter_ones(spark):
    sizes = {"a": [20000, 9000, 4000] + [10 + i % 90 for i in range(2000)], "b": [10 + i % 40 for i in range(3000)], "c": [30] * 400 + [2500]}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, own in sizes.items() for n in own)]
    mixed = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), leaf_docs=64, fan_in=4)
    for s, target, taken in mixed.groupBy("source").agg(F.max("target"), F.sum("taken")).collect():
        assert abs(taken / target - 1) < 0.005, s
    assert mixed.filter("taken > 3 * size").count() == 0


def test_a_source_of_one_document_draws_lots(spark):
    docs = spark.createDataFrame([(i, "w " * (1000 + i), f"s{i % 50:02d}") for i in range(50)], "doc_id long, text string, source string")
    check(docs, M.mix(docs))
    assert {r.copies for r in M.mix(docs).collect()} <= {0, 1, 2, 3}


def test_the_plan_of_a_mix_is_scans_of_what_was_rounded(odd_docs):
    """What its driver compiles and broadcasts does not grow with bands and levels: before, each gave joins of its own."""
    mixed = M.mix(odd_docs, leaf_docs=3, fan_in=2)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") <= 2
