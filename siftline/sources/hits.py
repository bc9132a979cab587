"""Search hits from backend replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..functions.dates import first_date
from ..schema import API_PAGE


def hits_from_json(pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """Replies (query_id, page_no, body as JSON text) as hits: query_id, rank, url, title, snippet, engines, published_at,
    metadata.

    rank counts from 1 over all pages of a query. engines falls back to the one engine. metadata has original_rank and, where
    present, category, date and published_at (raw texts).
    """
    parsed = pages.select("query_id", "page_no", F.from_json("body", API_PAGE).alias("p"))
    rows = parsed.select("query_id", "page_no", F.posexplode("p.results").alias("i", "r"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("page_no", "i")))
    r = F.col("r")
    text = lambda c: F.coalesce(c, F.lit(""))
    published, raw = first_date([r["published_at"], r["publishedDate"], r["published"], r["date"]])
    engines = F.when(F.size(F.coalesce(r["engines"], F.array().cast("array<string>"))) > 0, r["engines"]).when(text(r["engine"]) != "", F.array(r["engine"])).otherwise(F.array().cast("array<string>"))
    metadata = F.create_map(F.lit("original_rank"), F.col("rank").cast("string"), F.lit("category"), text(r["category"]), F.lit("date"), trim_space(text(r["date"])), F.lit("published_at"), raw)
    hits = rows.select(
        "query_id", "rank", text(r["url"]).alias("url"), text(r["title"]).alias("title"), text(r["content"]).alias("snippet"), engines.alias("engines"),
        published.alias("published_at"), F.map_filter(metadata, lambda k, v: v != "").alias("metadata"),
    )
    return hits.filter(F.col("rank") <= max_results) if max_results else hits
