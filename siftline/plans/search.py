"""The composed search: hits of many requests to ranked, deduplicated results with passages.

Order matters and is kept: fusion and the candidate cap come before the domain filter; document frequencies are taken after
exact and before near-duplicate removal; passages before near-duplicates; the limit comes last, so that dropped
duplicates free their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import chunks, content, dedupe, fusion, rank
from ..session import cut, spread, table
from ..sources import extract
from . import fixtures
from .registry import query


def search(
    queries: DataFrame, hits: DataFrame, pages: DataFrame, as_of: Column, max_results: int = 10, cap: int = 50, per_source: int = 3,
    include: list[str] | None = None, exclude: list[str] | None = None,
) -> DataFrame:
    """queries (query_id, q), hits as fusion.fuse takes them, pages as extract.parse_pages gives them (canonical, content).

    Returns query_id, rank, url, title, score, published_at, unsupported, chunks (text, score).
    """
    array = lambda items: F.array(*map(F.lit, items or [])).cast("array<string>")
    found = fusion.fuse(hits, cap).withColumnsRenamed({"rank": "pos", "score": "rrf"})
    found = found.filter(urls.domain_allowed(F.col("url"), array(include), array(exclude)))
    stored = pages.groupBy("canonical").agg(F.first("content", ignorenulls=True).alias("content"))
    rows = found.join(queries, "query_id").join(stored.withColumnRenamed("canonical", "url"), "url", "left")
    rows = rows.withColumns({"author": F.lit(""), "markdown": F.lit(""), "html": F.lit(""), "unsupported": F.when(F.col("content").isNull(), "fetch_failed").otherwise("")})
    rows = content.apply_content(rows).withColumn("main_text", F.coalesce("content.main_text", F.lit("")))
    rows = cut(dedupe.dedupe_content(rows, ["query_id"], "pos", "main_text"))  # read by every step below

    ranking = rows.select("query_id", "pos", "q", F.coalesce(F.nullif("content.title", F.lit("")), "title").alias("title"), F.concat_ws(" ", "snippet", "main_text").alias("text"))
    quality = rank.quality_adjustment(F.col("q"), F.col("url"), F.col("published_at"), F.col("unsupported"), as_of)
    scored = rows.join(rank.bm25(ranking, "pos"), ["query_id", "pos"])
    scored = scored.withColumn("score", rank.total_score(F.col("q"), F.col("bm25"), F.col("engines"), quality)).drop("bm25")
    ordered = cut(rank.ranked(scored).withColumn("pos", F.col("rank")).drop("rank"))

    source = chunks.source_text(F.col("content.main_text"), F.col("content.markdown"))
    context = chunks.scoring_context(F.col("title"), F.col("snippet"), F.col("content.title"), F.col("content.description"))
    parts = chunks.score_chunks(ordered.select("query_id", "pos", "q", source.alias("text"), context.alias("context")), "query_id", "pos")
    best = chunks.top_chunks(parts, per_source, "query_id", "pos").groupBy("query_id", "pos").agg(F.array_sort(F.collect_list(F.struct("chunk_rank", "chunk", "score"))).alias("c"))
    passages = best.select("query_id", "pos", F.transform("c", lambda x: F.struct(x["chunk"].alias("text"), x["score"].alias("score"))).alias("chunks"))

    kept = dedupe.collapse_near_duplicates(ordered.select("query_id", "pos", "score", F.col("main_text").alias("text"), "url", "title", "published_at", "unsupported"))
    final = rank.ranked(kept, max_results).drop("text")
    return final.join(passages, ["query_id", "pos"], "left").select("query_id", "rank", "url", "title", "score", "published_at", "unsupported", "chunks")


def request_queries(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, q) for each request of the hits: its own item, or where there is none, the item in its place, counted around."""
    item = items.select((F.row_number().over(Window.orderBy("query_id")) - 1).alias("place"), "q")
    asked = hits.select("query_id").distinct().join(items, "query_id", "left")
    lost = asked.filter("q is null").select("query_id").crossJoin(items.agg(F.count("*").alias("n"))).filter("n > 0")
    dealt = lost.withColumn("place", F.col("query_id") % F.col("n")).join(item, "place").select("query_id", "q")
    return asked.filter("q is not null").unionByName(dealt)


@query("search_pipeline")
def search_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All requests of the hits fixture, with the benchmark's words as queries. A request without an item of its own takes another's
    words."""
    hits = fixtures.hits(spark, folder).withColumn("metadata", F.create_map(F.lit("src"), "variant"))
    pages = extract.parse_pages(spread(table(spark, folder, "pages")))
    out = search(request_queries(hits, fixtures.queries(spark, folder)), hits, pages, fixtures.as_of())
    return out.withColumn("chunks", F.to_json("chunks"))
