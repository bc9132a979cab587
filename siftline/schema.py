"""Schemas of the data model: one row per search result, nested content, explicit order columns."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])

CONTENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "title", "author", "site_name", "description", "language", "main_text", "markdown", "cleaned_html", "unsupported_reason")]
    + [T.StructField("published_at", T.TimestampType())]
)

RESULT = T.StructType(
    [
        T.StructField("query_id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType()), T.StructField("engines", T.ArrayType(T.StringType())), T.StructField("author", T.StringType()),
        T.StructField("published_at", T.TimestampType()), T.StructField("markdown", T.StringType()), T.StructField("html", T.StringType()),
        T.StructField("unsupported", T.StringType()), T.StructField("content", CONTENT), T.StructField("score", T.DoubleType()), T.StructField("from_cache", T.BooleanType()),
        T.StructField("fetch_ms", T.LongType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("chunks", T.ArrayType(CHUNK)),
    ]
)

#: A page of the search backend. Dates may be strings or numbers, so they are read as strings.
API_RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "title", "content", "engine", "category", "published_at", "publishedDate", "published", "date")]
    + [T.StructField("engines", T.ArrayType(T.StringType()))]
)
API_PAGE = T.StructType([T.StructField("query", T.StringType()), T.StructField("results", T.ArrayType(API_RESULT)), T.StructField("unresponsive_engines", T.ArrayType(T.ArrayType(T.StringType())))])

UNSUPPORTED_REASONS = ["fetch_failed", "robots_disallowed", "non_html", "too_large", "decompressed_too_large", "extract_failed", "js_required", "render_failed", "egress_reject"]
