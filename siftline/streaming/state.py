"""Keyed state machines: token bucket, cooldown (R1, R5), as batch folds and as streams.

The folds read a key's events in time order, in one pass; the streams keep the same state for each key and process
the same step, so that both agree on ordered input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import fold_sorted

RATE, BURST = 5.0, 20.0


def refill(tokens: float | None, last_ms: int | None, now_ms: int, rate: float, burst: float) -> tuple[float, bool]:
    """One request: (tokens left, allowed)."""
    tokens, last_ms = burst if tokens is None else tokens, now_ms if last_ms is None else last_ms
    tokens = min(burst, tokens + max(0, now_ms - last_ms) / 1000 * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def token_bucket(requests: DataFrame, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """R1 over requests (key, ts, seq): key, seq, allowed, tokens (left). Linear in the requests of a key."""

    def step(state, now, seq):
        tokens, last = state or (None, None)
        tokens, allowed = refill(tokens, last, last if now is None else now, rate, burst) if (now, last) != (None, None) else (burst - 1, burst >= 1)
        return (tokens, last if now is None else now), (seq, allowed, tokens)

    return fold_sorted(requests, "key", [F.unix_millis(F.col("ts").cast("timestamp")), F.col("seq")], step, f"seq {requests.schema['seq'].dataType.simpleString()}, allowed boolean, tokens double")


class TokenBucket(StatefulProcessor):
    """R1 as a stream: state (tokens, time) by key, forgotten after twice the time that fills the bucket."""

    def __init__(self, rate: float = RATE, burst: float = BURST):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(max(2.0, 2 * self.burst / self.rate) * 1000)
        self.state = handle.getValueState("bucket", T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("ms", T.LongType())]), ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tokens, last = self.state.get() if self.state.exists() else (None, None)
        for batch in rows:
            out = []
            for ts, seq in sorted(zip(batch["ts"], batch["seq"])):
                now = int(pd.Timestamp(ts).timestamp() * 1000)
                tokens, allowed = refill(tokens, last, now, self.rate, self.burst)
                last = now
                out.append((key[0], seq, allowed, tokens))
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "tokens"])
        self.state.update((tokens, last))

    def close(self) -> None:
        pass


def token_bucket_stream(requests: DataFrame, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """Needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(TokenBucket(rate, burst), "key long, seq long, allowed boolean, tokens double", "Append", "ProcessingTime")


def bucket_in_pandas_with_state(requests: DataFrame, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """R1 as a stream on any state store."""

    def step(key, batches, state):
        tokens, last = state.get if state.exists else (None, None)
        for batch in batches:
            out = []
            for ts, seq in sorted(zip(batch["ts"], batch["seq"])):
                now = int(pd.Timestamp(ts).timestamp() * 1000)
                tokens, allowed = refill(tokens, last, now, rate, burst)
                last = now
                out.append((key[0], seq, allowed, tokens))
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "tokens"])
        state.update((tokens, last))

    return requests.groupBy("key").applyInPandasWithState(step, "key long, seq long, allowed boolean, tokens double", "tokens double, ms long", "append", "NoTimeout")


def cooldown(outcomes: DataFrame, cooldown_seconds: int = 30) -> DataFrame:
    """R5 over calls (instance, ts, seq, ok): whether the instance was cooling when the call came. An error starts the cooldown,
    a success ends it, so the call before tells."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("instance").orderBy("ts", "seq", "ok")
    cooling = ~F.lag("ok").over(before) & (t < F.lag(t).over(before) + cooldown_seconds * 1_000_000)
    return outcomes.select("instance", "seq", F.coalesce(cooling, F.lit(False)).alias("cooling"))


def cooldown_stream(outcomes: DataFrame, cooldown_seconds: int = 30) -> DataFrame:
    """R5 as a stream on any state store: instance, seq, cooling."""

    def step(key, batches, state):
        until = state.get[0] if state.exists else None
        for batch in batches:
            out = []
            for ts, seq, ok in sorted(zip(batch["ts"], batch["seq"], batch["ok"])):
                now = int(pd.Timestamp(ts).timestamp() * 1_000_000)
                out.append((key[0], seq, until is not None and now < until))
                until = None if ok else now + cooldown_seconds * 1_000_000
            yield pd.DataFrame(out, columns=["instance", "seq", "cooling"])
        state.update((until,))

    return outcomes.groupBy("instance").applyInPandasWithState(step, "instance long, seq long, cooling boolean", "until long", "append", "NoTimeout")


def engine_health_update(outcomes: DataFrame) -> DataFrame:
    """The latest verdict of each engine; on a stream, an update-mode table (engine, unhealthy)."""
    return outcomes.groupBy("engine").agg(F.max_by("bad", "ts").alias("unhealthy"))


def windowed_counts(events: DataFrame, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and label; on a stream, late rows are waited for as long as ``late``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), label).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp").alias("start"), label, "n")
