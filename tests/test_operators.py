"""Literal rows for what the tables do not hold."""

import json
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.functions import dates, intent, policy, requests, text, urls
from siftline.operators import cache, chunks, content, dedupe, fusion, metrics, rank
from siftline.sources import extract, hits, metasearch, robots, summarize
from siftline.streaming import state


def one(spark, column, **values):
    names = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for k, v in values.items()}
    return spark.range(1).select(*[v.alias(k) for k, v in names.items()]).select(column.alias("x")).first()[0]


def test_rank_tokens(spark):
    assert one(spark, text.rank_tokens(F.col("t")), t="Hello, world! It's 2024.") == ["hello", "world", "it", "2024"]
    assert one(spark, text.rank_tokens(F.col("t")), t="é 中 a") == ["é", "中"]
    assert one(spark, text.chunk_tokens(F.col("t")), t="class this cats is") == ["clas", "thi", "cat", "is"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://Example.com:443/a/b?utm_source=x&z=1&a=2#frag", "https://example.com/a/b?a=2&z=1"), ("http://example.com:80/", "http://example.com/"), ("https://e.com/?b=2&b=1&a=3", "https://e.com/?a=3&b=1&b=2"),
        ("https://e.com/?q=a%20b&GCLID=1", "https://e.com/?q=a+b"), ("/relative", None), ("mailto:x@y.z", None), ("https://e.com/?x=~*", "https://e.com/?x=~%2A"),
    ],
)
def test_canonical_url(spark, raw, want):
    out = one(spark, urls.canonical_url(F.col("u")), u=raw)
    assert out == want
    if want:
        assert one(spark, urls.canonical_url(F.col("u")), u=out) == out


def test_domain_filters(spark):
    allowed = lambda u, inc, exc: one(spark, urls.domain_allowed(F.col("u"), F.col("i"), F.col("e")), u=u, i=inc, e=exc)
    assert allowed("https://docs.a.example/x", ["a.example"], []) and not allowed("https://nota.example/x", ["a.example"], [])
    assert not allowed("https://a.example/x", ["a.example"], ["www.a.example"]) and allowed("https://a.example/x", ["  "], [])
    assert allowed("https://a.example/docs", ["*.a.example/doc/"], []) and not allowed("https://a.example/Doc", ["a.example/doc"], [])


def test_query_variants(spark):
    variants = one(spark, intent.query_variants(F.col("q")), q=" latest  golang api 2026 ")
    assert [(v.label, v.q, v.exact) for v in variants] == [
        ("original", "latest golang api 2026", False), ("exact", "latest golang api 2026", True), ("freshness", "latest golang api 2026 news", False), ("docs", "latest golang api 2026 official docs", False),
    ]
    assert one(spark, intent.query_variants(F.col("q")), q="  ") == []


def cut(body, most=500):
    out = []
    for p in body.strip().split("\n\n"):
        p = p.strip()
        while len(p) > most:
            at = max(p[:most].rfind(c) for c in ".!? ")
            at = most if at < most // 2 else at
            out.append(p[:at].strip())
            p = p[at:].strip()
        if p:
            out.append(p)
    return out


def test_split_chunks():
    rng = random.Random(1)
    for _ in range(200):
        body = "".join(rng.choice(["word", " ", ". ", "x" * rng.randint(1, 400), "\n\n", "!"]) for _ in range(rng.randint(0, 60)))
        assert text.cut_chunks(body) == cut(body)
    assert text.cut_chunks("a" * 501) == ["a" * 500, "a"] and text.cut_chunks(None) == text.cut_chunks(" ") == []
    assert "".join(text.cut_chunks("é" * 600)).count("é") == 600  # 500 bytes fall between two-byte characters
    assert "�" in "".join(text.cut_chunks("中" * 600))


def test_phrases_beat_bags_of_words(spark):
    rows = spark.createDataFrame([(1, "solar panel cost", "The solar panel cost fell.", ""), (2, "solar panel cost", "Panel of judges; solar eclipse; cost of living.", ""), (3, "solar panel cost", "Nothing here.", "solar")], "id int, q string, text string, context string")
    scored = {r.id: r.score for r in chunks.score_chunks(rows, "id").collect()}
    assert scored[1] > scored[2] > scored[3] == 0
    expected = 1 + 0.35 * math.log1p(3) / 3 + 0.75 + 2 * 0.18
    assert abs(scored[1] - expected * 0.85) < 1e-9
    assert [r.id for r in chunks.top_chunks(chunks.score_chunks(rows, "id"), 3, "id").orderBy("id").collect()] == [1, 2]


def test_near_duplicates_are_greedy_and_by_preference(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, 0, 1.0, base), (1, 1, 1.0, base + " tail"), (1, 2, 0.5, base), (1, 3, 0.4, "quite another text"), (1, 4, 0.4, ""), (1, 5, 0.1, ""), (2, 0, 1.0, base)]
    kept = dedupe.collapse_near_duplicates(spark.createDataFrame(rows, "query_id long, pos int, score double, text string"))
    assert sorted((r.query_id, r.pos) for r in kept.collect()) == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 0)]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") for _ in range(40)] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(40)] = rng.choice("abcdefgh")
            docs.append(" ".join(c))
    sets = [{tuple(d.split()[i : i + 3]) for i in range(38)} for d in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    frame = spark.createDataFrame(list(enumerate(docs)), "id long, text string").select("id", text.shingles(F.col("text")).alias("shingles"))
    assert {(r.a, r.b) for r in dedupe.similar_pairs(frame, [], "id").collect()} == want and want


def test_cjk_texts_are_compared_by_characters(spark):
    assert one(spark, text.shingles(F.col("t")), t="東京 大阪") == ["東京", "京大", "大阪"]
    assert one(spark, text.shingles(F.col("t")), t="Two words") == ["two", "words"]
    assert not one(spark, text.is_cjk_dominant(F.col("t")), t="漢 abcdefghij")


def test_fusion_merges_across_variants(spark):
    schema = "query_id long, variant string, variant_ord int, rank int, url string, title string, snippet string, engines array<string>, published_at timestamp, metadata map<string,string>"
    rows = [
        (1, "original", 0, 1, "https://a.example/?utm_source=x", "A", "", ["e1"], None, {"k": "first"}), (1, "original", 0, 2, "https://b.example", "", "sb", ["e1"], None, None), (1, "exact", 1, 1, "https://b.example", "B", "late", ["e2", "e1"], None, {"z": "1"}),
        (1, "docs", 2, 1, "https://b.example", "B2", "", ["e3"], None, {"z": "2"}), (1, "docs", 2, 2, "relative", "R", "", [], None, {}),
    ]
    out = {r.url: r for r in fusion.fuse(spark.createDataFrame(rows, schema)).collect()}
    b = out["https://b.example"]
    assert (b.rank, b.title, b.snippet, b.engines) == (1, "B", "sb", ["e1", "e2", "e3"])
    assert b.metadata == {"z": "1", "rrf_score": f"{1 / 62 + 2 / 61:.6f}", "rrf_variants": "original,exact,docs", "rrf_original_rank": "2"}
    assert out["https://a.example/"].metadata["k"] == "first" and "relative" in out
    assert [r.rank for r in fusion.fuse(spark.createDataFrame(rows, schema), 2).collect()] == [1, 2]


def test_titles_weigh_twice_and_repeated_query_words_count_again(spark):
    rows = [(1, "1", 0, "rust rust", "rust guide", "about memory"), (1, "2", 1, "rust rust", "guide", "rust about memory"), (1, "3", 2, "rust rust", "", None)]
    out = {r.key: r.bm25 for r in rank.bm25(spark.createDataFrame(rows, "query_id long, key string, pos int, q string, title string, text string"), "key").collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 8 / 3
    score = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
    assert out["3"] == 0 and abs(out["1"] - score(2, 4)) < 1e-9 and abs(out["2"] - score(1, 4)) < 1e-9


def test_dates_take_the_first_that_parses(spark):
    frame = spark.createDataFrame([("bad", "2026-04-02", None), ("", "nope", "x")], "a string, b string, c string")
    published, raw = dates.first_date([F.col(c) for c in "abc"])
    out = frame.select(published.cast("string").alias("p"), raw.alias("r")).collect()
    assert [tuple(r) for r in out] == [("2026-04-02 00:00:00", "2026-04-02"), (None, "nope")]


def test_hits_are_numbered_over_pages(spark):
    body = lambda *us: json.dumps({"results": [{"url": u, "engine": "e"} for u in us]})
    frame = spark.createDataFrame([(1, 2, body("c")), (1, 1, body("a", "b")), (2, 1, body())], "query_id int, page_no int, body string")
    assert [(r.rank, r.url) for r in hits.hits_from_json(frame, 2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_backend_pages_stop_and_fail_over():
    calls = []

    def fetch(url):
        calls.append(url)
        if "down" in url:
            raise OSError
        page = int(re.search(r"pageno=(\d+)", url)[1]) if "pageno" in url else 1
        return json.dumps({"results": [{"url": "u"}] * (2 if page < 3 else 0)})

    clock = [0.0]
    pool = metasearch.Instances(["http://down", "http://up"], 30, lambda: clock[0])
    assert [p for p, _ in metasearch.read_pages({"text": "q", "max_results": 10}, pool, 0, fetch)] == [1, 2]
    assert sum("down" in c for c in calls) == 1  # cooling after its first failure
    assert len(list(metasearch.read_pages({"text": "q"}, pool, 0, fetch))) == 1 and "pageno" not in calls[-1]
    clock[0] = 31
    assert pool.order(0)[0] == "http://down"
    with pytest.raises(ValueError):
        list(metasearch.read_pages({"text": " "}, pool, 0, fetch))
    assert "safesearch=0" in metasearch.request_url("http://up/", {"text": "q", "safesearch": 0, "engines": ["a", "b"], "language": ""}, None)


def test_data_source_reads_queries(spark):
    class Offline(metasearch.MetaSearchSource):
        fetch = staticmethod(lambda url: json.dumps({"results": [{"url": url}] if "pageno=1" in url else []}))

    spark.dataSource.register(Offline)
    queries = json.dumps([{"query_id": i, "text": f"q{i}", "max_results": 3} for i in range(3)])
    out = spark.read.format("metasearch").options(instances="http://a,http://b", queries=queries).load()
    assert sorted(r.query_id for r in out.collect()) == [0, 1, 2]


def test_robots_fail_open(spark):
    rules = spark.createDataFrame([("https://a.example", 200, "User-agent: *\nDisallow: /private"), ("https://b.example", 500, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    asked = spark.createDataFrame([(u, "bot") for u in ("https://A.example/private/x?y", "https://a.example/open?x=/private", "https://b.example/x", "https://c.example/")], "url string, agent string")
    assert [r.allowed for r in robots.robots_allowed(asked, rules).orderBy("url").collect()] == [False, True, True, True]


def test_extraction():
    page = extract.extract_page("<html><head><title> T  &amp; U </title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b>.</p><script>x()</script><ul><li>item</li></ul></article><footer>f</footer></body></html>")
    assert page == {"title": "T & U", "main_text": "Head\n\nOne two.\n\nitem", "markdown": "# Head\n\nOne two.\n\n- item"}
    assert extract.extract_page("<p>only body</p>")["main_text"] == "only body" and extract.extract_page(None)["main_text"] == ""


def test_prompt_cut_is_in_bytes(spark):
    prompt = one(spark, content.cut_bytes(F.col("t"), 5), t="aéééé")
    assert prompt == "aéé" and one(spark, content.cut_bytes(F.col("t"), 4), t="aéé") == "aé"


def test_summaries_report_errors_as_rows(spark):
    def provider(prompt, model):
        if "bad" in prompt:
            raise TimeoutError
        return ("" if "none" in prompt else "ok"), 3, 1, 0

    frame = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "key long, prompt string")
    out = summarize.summarize(frame, provider, "p").orderBy("key").collect()
    assert [r.error for r in out] == [None, "TimeoutError", "empty"]
    assert summarize.usage(summarize.summarize(frame, provider, "p")).first().total_tokens == 8


def test_histogram_is_cumulative(spark):
    frame = spark.createDataFrame([("a", 0.05), ("a", 0.3), ("a", 99.0)], "k string, s double")
    out = {r.le: r.cumulative for r in metrics.histogram(frame, "s", [0.05, 1.0], "k").collect()}
    assert out == {0.05: 1, 1.0: 2, float("inf"): 3}


def test_secrets(spark):
    assert one(spark, policy.mask_key(F.col("k")), k="sk-12345678") == "***5678"
    assert one(spark, policy.mask_url(F.col("k")), k="redis://u:p@h:1") == "redis://…@h:1"


def test_token_bucket_stream_equals_the_fold(spark, tmp_path):
    rows = [(i % 3, datetime(2024, 1, 1) + timedelta(milliseconds=150 * i), i) for i in range(120)]
    frame = spark.createDataFrame(rows, "key long, ts timestamp, seq long")
    want = {(r.key, r.seq): r.allowed for r in state.token_bucket(frame, 1.0, 4.0).collect()}
    assert len(set(want.values())) == 2
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    running = state.bucket_in_pandas_with_state(stream, 1.0, 4.0).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    running.awaitTermination(90)
    assert {(r.key, r.seq): r.allowed for r in spark.table("bucket").collect()} == want


def test_cooldown_stream_equals_the_fold(spark, tmp_path):
    rows = [(i % 2, datetime(2024, 1, 1) + timedelta(seconds=11 * i), i, i % 5 != 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "instance long, ts timestamp, seq long, ok boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    running = state.cooldown_stream(stream).writeStream.format("memory").queryName("cooldown").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    running.awaitTermination(90)
    want = sorted(map(tuple, state.cooldown(frame).collect()))
    assert sorted(map(tuple, spark.table("cooldown").collect())) == want and len({w[2] for w in want}) == 2


@pytest.mark.parametrize(
    "ip, public",
    [("2606:4700::1111", True), ("::1", False), ("::", False), ("fc00::1", False), ("fe80::1", False), ("ff02::1", False), ("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True), ("8.8.8.8", True), ("10.0.0.1", False), ("example.com", None), ("1:2", None)],
)
def test_addresses_of_both_families(spark, ip, public):
    assert one(spark, policy.is_public_ip(F.col("ip")), ip=ip) is public


def test_user_agents(spark):
    choose = lambda override, respect, pool: one(spark, policy.choose_user_agent(F.lit("https://a.example"), F.col("o"), F.lit("default"), F.col("p"), F.lit(respect)), o=override, p=pool)
    assert choose("mine", False, ["x"]) == "mine" and choose("", True, ["x"]) == "default" and choose("", False, []) == "default" and choose("", False, ["x", "y"]) in ("x", "y")


def test_token_bucket_with_state_store(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1) + timedelta(milliseconds=100 * i), i) for i in range(30)]
    frame = spark.createDataFrame(rows, "key long, ts timestamp, seq long")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        running = state.token_bucket_stream(stream, 1.0, 4.0).writeStream.format("memory").queryName("bucket2").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        running.awaitTermination(90)
        want = {r.seq: r.allowed for r in state.token_bucket(frame, 1.0, 4.0).collect()}
        assert {r.seq: r.allowed for r in spark.table("bucket2").collect()} == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=7 * i), "a" if i % 2 else "b") for i in range(40)]
    frame = spark.createDataFrame(rows, "ts timestamp, kind string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    running = state.windowed_counts(stream, "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    running.awaitTermination(90)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, state.windowed_counts(frame, "kind").collect()))


def test_folds_are_linear_in_the_events_of_a_key(spark):
    """One key of 60,000 events, among others."""
    import time

    from siftline.operators import cache

    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("key"), F.timestamp_millis(F.col("id") * 150).alias("ts"), F.col("id").alias("seq"))
    began = time.time()
    got = [r.allowed for r in state.token_bucket(rows, 5.0, 20.0).orderBy("seq").collect()]
    hits = cache.simulate(rows, 3).filter("hit").count()
    assert time.time() - began < 30
    tokens, last, want = None, None, []
    for i in range(60_000):
        tokens, allowed = state.refill(tokens, last, i * 150, 5.0, 20.0)
        last = i * 150
        want.append(allowed)
    assert got == want and hits == 60_000 - -(-60_000 // 21)


def test_a_query_without_tokens_keeps_the_order(spark):
    rows = spark.createDataFrame([("?!", 1.0), ("word", 1.0)], "q string, b double")
    scores = [r.s for r in rows.select(rank.total_score(F.col("q"), F.col("b"), F.array(F.lit("x")), F.lit(-0.5)).alias("s")).collect()]
    assert scores == [0.0, 0.5]


def test_white_space_of_any_kind_is_blank(spark):
    from siftline.operators import chunks, content

    blank = "\n\t\u00a0\u2003"
    rows = spark.createDataFrame([(blank, "m")], "a string, b string")
    assert rows.select(chunks.source_text(F.col("a"), F.col("b")).alias("s")).first().s == "m"
    assert "Extra" not in rows.select(content.summarize_prompt(F.lit("x"), F.col("a"), F.col("a")).alias("s")).first().s


def test_clusters_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from siftline.session import checkpoint_folder

    conf = SimpleNamespace(get=lambda key, default: default)
    context = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert checkpoint_folder(context("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            checkpoint_folder(context(master))


def test_request_gates_defaults_and_caps(spark):
    gate = lambda **v: one(spark, requests.option_error(F.col("a"), F.col("r").cast("boolean"), F.col("p").cast("string")), **v)
    assert gate(a=False, r=False, p=None).startswith("forbidden: respect_robots") and gate(a=False, r=None, p="x").startswith("forbidden: proxy_url")
    assert gate(a=True, r=False, p="x") is None and gate(a=False, r=True, p="") is None and gate(a=False, r=None, p=None) is None
    thinking = F.struct(F.lit(True).alias("enabled"), F.lit(10).alias("budget_tokens"), F.lit("").alias("effort"))
    asked = lambda t: requests.request_error(F.lit("m"), F.lit("p"), F.lit(None).cast("int"), t)
    assert one(spark, asked(thinking), x0=1) == "thinking.budget_tokens must be >= 1024 (got 10)" and one(spark, asked(F.lit(None).cast("struct<enabled:boolean,budget_tokens:int>")), x0=1) is None
    assert one(spark, requests.choose_text(F.col("a"), F.col("b")), a=" \n", b="d") == "d" and one(spark, requests.choose_positive(F.col("a").cast("int"), F.col("b")), a=None, b=3) == 3
    assert one(spark, requests.first_set(F.col("a").cast("string"), F.col("b")), a=None, b="") == ""


def test_robots_entries_expire_at_their_lifetime_and_failures_are_kept(spark):
    rows = [("a", "old", "2024-01-01 00:00:00"), ("b", "young", "2024-01-01 00:00:01"), ("c", "stale", "2024-01-01 00:30:00"), ("d", None, "2024-01-01 00:30:00")]
    entries = spark.createDataFrame(rows, "origin string, value string, at string").select("origin", "value", F.col("at").cast("timestamp").alias("written_at"))
    fetched = spark.createDataFrame([("c", None)], "origin string, value string")
    out = cache.insert_and_sweep(entries, fetched, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert sorted((r.origin, r.value) for r in out.collect()) == [("b", "young"), ("c", None), ("d", None)]
    assert cache.insert_and_sweep(entries.limit(0), fetched.limit(0), F.lit("2024-01-01 01:00:00").cast("timestamp")).count() == 0
