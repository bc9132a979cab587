"""Counters, histograms and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds in seconds.
FETCH_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 15.0]
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
RENDER_BUCKETS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 15.0, 30.0, 60.0]
SUMMARIZE_BUCKETS = [0.5, 1.0, 2.0, 4.0, 8.0, 15.0, 30.0, 60.0, 120.0]


def counters(log: DataFrame, *labels: str, value: Column | None = None) -> DataFrame:
    """The number of rows, or the sum of a value, by labels."""
    return log.groupBy(*labels).agg((F.sum(value) if value is not None else F.count("*")).alias("value"))


def histogram(log: DataFrame, seconds: str, buckets: list[float], *labels: str) -> DataFrame:
    """Cumulative counts by upper bound, with the sum and the count of all. One pass: a conditional count for each bound."""
    bounds = [F.count_if(F.col(seconds) <= b).alias(f"_{i}") for i, b in enumerate(buckets)]
    wide = log.groupBy(*labels).agg(*bounds, F.count(seconds).alias("count"), F.sum(seconds).alias("sum"))
    long = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(buckets)], F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative"))))
    return wide.select(*labels, long.alias("b"), "count", "sum").select(*labels, "b.le", "b.cumulative", "count", "sum")


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def engine_health(pages: DataFrame) -> DataFrame:
    """Of replies (ts, engines, unresponsive): for each engine seen so far whether its latest mention was a failure. An
    engine is mentioned by a reply that it answered or failed in; all known engines that a reply does not blame are well."""
    seen = pages.select("ts", F.explode(F.concat(F.transform("engines", lambda e: F.struct(e.alias("engine"), F.lit(False).alias("bad"))), F.transform("unresponsive", lambda e: F.struct(e.alias("engine"), F.lit(True).alias("bad"))))).alias("e"))
    latest = seen.groupBy("e.engine").agg(F.max(F.when(F.col("e.bad"), F.col("ts"))).alias("blamed"))
    last = pages.agg(F.max("ts").alias("last"))
    return latest.crossJoin(F.broadcast(last)).select("engine", F.coalesce(F.col("blamed") == F.col("last"), F.lit(False)).alias("unhealthy"))


def label_string(labels: Column) -> Column:
    """sorted k=v pairs."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
