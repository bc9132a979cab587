"""Artifact cache as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold_sorted

TTL_SECONDS = 3600


def latest(artifacts: DataFrame, key: str = "key") -> DataFrame:
    """The last write of each key."""
    return artifacts.groupBy(key).agg(F.max_by(F.struct("value", "written_at"), F.col("written_at")).alias("r")).select(key, "r.*")


def upsert(artifacts: DataFrame, writes: DataFrame, key: str = "key") -> DataFrame:
    """The artifacts after the writes: of each key the last write."""
    return latest(artifacts.select(key, "value", "written_at").unionByName(writes.select(key, "value", "written_at")), key)


def insert_and_sweep(entries: DataFrame, fetched: DataFrame, now, ttl_seconds: int = TTL_SECONDS, key: str = "origin") -> DataFrame:
    """A table of robots rules (key, value, written_at) after an insert at ``now``. Entries of the lifetime's age or older are swept out, failures
    (a null value) are kept like any other, and what is fetched anew replaces what was there."""
    young = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("written_at").cast("timestamp")) < ttl_seconds * 1_000_000
    fresh = fetched.select(key, "value", now.cast("timestamp").alias("written_at")).dropDuplicates([key])
    kept = entries.select(key, "value", "written_at").filter(young).join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def lookup(requests: DataFrame, artifacts: DataFrame, as_of, ttl_seconds: int = TTL_SECONDS, key: str = "key") -> DataFrame:
    """Requests with the artifact that is valid at as_of, and whether there is one."""
    valid = latest(artifacts, key).filter(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("written_at").cast("timestamp")) <= ttl_seconds * 1_000_000)
    return requests.join(valid.select(key, "value"), key, "left").withColumn("from_cache", F.col("value").isNotNull())


def misses(requests: DataFrame, artifacts: DataFrame, as_of, ttl_seconds: int = TTL_SECONDS, key: str = "key") -> DataFrame:
    """The distinct keys to fetch."""
    valid = latest(artifacts, key).filter(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("written_at").cast("timestamp")) <= ttl_seconds * 1_000_000)
    return requests.select(key).distinct().join(valid, key, "left_anti")


def simulate(accesses: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """R2: accesses (key, ts, seq) of a cache that stores on a miss: whether each one hits.

    A key is stored at its first access and again at the first one later than the store's expiry. One pass over the key's sorted
    accesses.
    """

    def step(stored, t, seq):
        live = stored is not None and t is not None and t - stored <= ttl_seconds * 1_000_000
        return (stored if live else t), (seq, live)

    return fold_sorted(accesses, "key", [F.unix_micros(F.col("ts").cast("timestamp")), F.col("seq")], step, f"seq {accesses.schema['seq'].dataType.simpleString()}, hit boolean")


def previous_hop(hops: DataFrame) -> DataFrame:
    """Each hop with the URL before it in its chain."""
    return hops.withColumn("previous", F.lag("url").over(Window.partitionBy("chain").orderBy("hop")))
