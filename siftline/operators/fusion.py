"""Reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url

RRF_CONSTANT = 60


def first_in_order(value: Column, order: Column, keep: Column) -> Column:
    """The value of the first row in order for which keep holds; null if none does."""
    return F.min_by(F.when(keep, value), F.when(keep, order))


def ordered_distinct(values: str, order: list[str]) -> Column:
    """Distinct elements of arrays, by first appearance in the order of the rows."""
    rows = F.array_sort(F.collect_list(F.struct(*order, values)))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.coalesce(r[values], F.array().cast("array<string>")))))


def first_wins(maps: str, order: list[str]) -> Column:
    """A5: union of maps; a key keeps the value of its first map."""
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.map_entries(maps).alias("e")))), lambda r: F.coalesce(r["e"], F.array().cast("array<struct<key:string,value:string>>"))))
    distinct = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(distinct)


def fuse(hits: DataFrame, cap: int | None = None) -> DataFrame:
    """A3: one row per query and canonical URL (the raw one where there is none).

    hits: query_id, variant, variant_ord, rank, url, title, snippet, engines, published_at, metadata. The score sums 1/(60 + rank)
    over all appearances. Title and snippet are the first that are not empty, published_at the first that is known, engines an
    ordered union, metadata first-wins with rrf_score, rrf_variants (each once) and rrf_original_rank put in; appearances holds the
    variant of each appearance, in order. Order: score, first appearance, URL.
    """
    hits = hits.withColumn("key", F.coalesce(canonical_url(F.col("url")), F.col("url")))
    order = ["variant_ord", "rank"]
    at = F.struct(*order)
    labels = F.transform(F.array_sort(F.collect_list(F.struct(*order, "variant"))), lambda r: r["variant"])
    fused = hits.groupBy("query_id", F.col("key").alias("url")).agg(
        F.sum(1 / (RRF_CONSTANT + F.col("rank"))).alias("score"), F.min(at).alias("first_seen"), first_in_order(F.col("title"), at, F.col("title") != "").alias("title"),
        first_in_order(F.col("snippet"), at, F.col("snippet") != "").alias("snippet"), first_in_order(F.col("published_at"), at, F.col("published_at").isNotNull()).alias("published_at"),
        ordered_distinct("engines", order).alias("engines"), first_wins("metadata", order).alias("merged"), labels.alias("appearances"),
    ).withColumn("variants", F.array_distinct("appearances"))
    extra = F.create_map(
        F.lit("rrf_score"), F.format_string("%.6f", "score"), F.lit("rrf_variants"), F.array_join("variants", ","), F.lit("rrf_original_rank"), F.col("first_seen.rank").cast("string")
    )
    own = F.map_filter("merged", lambda k, v: ~k.isin("rrf_score", "rrf_variants", "rrf_original_rank"))
    fused = fused.withColumns({"title": F.coalesce("title", F.lit("")), "snippet": F.coalesce("snippet", F.lit("")), "metadata": F.map_concat(own, extra)}).drop("merged")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", "url"))
    fused = fused.withColumn("rank", place)
    return fused.filter(F.col("rank") <= cap) if cap else fused


def dedupe_urls(hits: DataFrame) -> DataFrame:
    """A1: the first row of each canonical URL in a query's order, with the engines of all; rows whose URL is relative or has no
    host go. Adds canonical."""
    rows = hits.withColumn("canonical", canonical_url(F.col("url"))).filter("canonical is not null")
    names = [c for c in rows.columns if c not in ("query_id", "canonical", "engines")]
    first = F.min_by(F.struct(*names), F.col("pos")).alias("r")
    return rows.groupBy("query_id", "canonical").agg(first, ordered_distinct("engines", ["pos"]).alias("engines")).select("query_id", "canonical", "r.*", "engines")
