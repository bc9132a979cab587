"""Derived tables, in Spark and as DuckDB SQL with the same rules.

queries: the first four words of each benchmark item. candidates: every document is a candidate of one of 40 requests.
hits: every page is a hit of one of 50 requests, in three variants with orders of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, table
from ..sources.extract import raw_title

N_REQUESTS, N_HIT_REQUESTS = 40, 50
AS_OF = "2026-05-17 12:00:00"
VARIANTS = ["original", "exact", "freshness"]

QUERIES_SQL = r"queries AS (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '\s+')[1:4], ' ') AS q FROM benchmark)"
CANDIDATES_SQL = rf"""{QUERIES_SQL},
candidates AS (SELECT query_id, q, doc_id AS pos, doc_id, array_to_string(regexp_split_to_array(text, '\s+')[1:5], ' ') AS title, text
  FROM documents JOIN queries ON doc_id % {N_REQUESTS} = query_id)"""
HITS_SQL = rf"""hits AS (
  SELECT page_id % {N_HIT_REQUESTS} AS query_id, v.variant, v.ord AS variant_ord, page_id, url,
    CASE WHEN (page_id + v.ord) % 3 = 0 THEN '' ELSE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END AS title,
    CASE WHEN (page_id + v.ord) % 4 = 0 THEN '' ELSE 'page ' || page_id END AS snippet,
    ['e' || (page_id % 3), 'e' || (page_id % 5)] AS engines,
    CASE WHEN page_id % 4 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days((page_id % 200)::INTEGER) END AS published_at,
    row_number() OVER (PARTITION BY page_id % {N_HIT_REQUESTS}, v.ord ORDER BY (page_id * (31 + 7 * v.ord)) % 101, page_id) AS rank
  FROM pages, (VALUES ('original', 0), ('exact', 1), ('freshness', 2)) v(variant, ord))"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    first = lambda n: F.array_join(F.slice(F.split("text", r"\s+"), 1, n), " ")
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), first(4).alias("q"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 5), " ")
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).select((F.col("doc_id") % N_REQUESTS).alias("query_id"), F.col("doc_id").alias("pos"), "doc_id", title.alias("title"), "text")
    return docs.join(queries(spark, folder), "query_id")


def hits(spark: SparkSession, folder: str) -> DataFrame:
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(i).alias("ord")) for i, v in enumerate(VARIANTS)])
    rows = table(spark, folder, "pages").select("page_id", "url", raw_title(F.col("html")).alias("t"), F.explode(variants).alias("v"))
    page, order = F.col("page_id"), F.col("v.ord")
    place = Window.partitionBy("query_id", "variant_ord").orderBy((page * (31 + 7 * F.col("variant_ord"))) % 101, "page_id")
    return rows.select(
        (page % N_HIT_REQUESTS).alias("query_id"), F.col("v.variant").alias("variant"), order.alias("variant_ord"), "page_id", "url",
        F.when((page + order) % 3 == 0, "").otherwise(F.col("t")).alias("title"), F.when((page + order) % 4 == 0, "").otherwise(F.concat(F.lit("page "), page.cast("string"))).alias("snippet"),
        F.array(F.concat(F.lit("e"), (page % 3).cast("string")), F.concat(F.lit("e"), (page % 5).cast("string"))).alias("engines"),
        F.when(page % 4 != 0, F.timestamp_micros(F.unix_micros(as_of()) - (page % 200) * 86_400_000_000)).alias("published_at"),
    ).withColumn("rank", F.row_number().over(place))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return str(x)
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]" + ("::VARCHAR[]" if not x else "")
        return "'" + str(x).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
