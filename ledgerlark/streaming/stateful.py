"""Keyed state: token buckets and session locks over a stream or a table, and windowed counts with late data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_MINUTE, BURST = 30, 12
_DECISION = "key long, at_ms long, allowed boolean, retry_after_sec int"


def take(tokens: float, last_ms: int, now_ms: int, per_minute: int = PER_MINUTE, burst: int = BURST) -> tuple[float, bool, int]:
    """(tokens left, allowed, seconds to wait) of a bucket that refills all the time."""
    tokens = min(burst, tokens + max(0, now_ms - last_ms) * per_minute / 60000)
    if tokens >= 1:
        return tokens - 1, True, 0
    return tokens, False, math.ceil((1 - tokens) * 60 / per_minute)


def _limited(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    tokens, last = state.get if state.exists else (float(BURST), None)
    rows = pd.concat(list(pdfs)).sort_values("at_ms", kind="stable")
    out = []
    for at in rows["at_ms"]:
        tokens, allowed, wait = take(tokens, at if last is None else last, at)
        last = at
        out.append((key[0], at, allowed, wait))
    state.update((tokens, int(last)))
    yield pd.DataFrame(out, columns=["key", "at_ms", "allowed", "retry_after_sec"])


def rate_limited_stream(requests: DataFrame) -> DataFrame:
    """A decision for each request (key, at_ms) of a stream; a key's bucket lives in its state."""
    return requests.groupBy("key").applyInPandasWithState(_limited, _DECISION, "tokens double, last_ms long", "append", "NoTimeout")


def _bucket_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, tokens, last = None, float(BURST), 0
    for pdf in batches:
        out = []
        for k, at in zip(pdf["key"], pdf["at_ms"], strict=True):
            if k != key:
                key, tokens, last = k, float(BURST), at
            tokens, allowed, wait = take(tokens, last, at)
            last = at
            out.append((k, at, allowed, wait))
        yield pd.DataFrame(out, columns=["key", "at_ms", "allowed", "retry_after_sec"])


def rate_limited(requests: DataFrame) -> DataFrame:
    """The same over a table: rows are dealt by key, sorted by time and streamed, with one bucket held at a time.

    Requests without a key are nobody's and have no row. A bucket's requests depend on each other, so one task streams them.
    """
    return requests.where("key is not null and at_ms is not null").select("key", "at_ms").repartition("key").sortWithinPartitions("key", "at_ms").mapInPandas(_bucket_rows, _DECISION)


def session_locks(runs: DataFrame) -> DataFrame:
    """(session_id, run_id, acquired): a run gets its session's lock if the last holder has ended by its start.

    ``runs`` has session_id, run_id, started, ended. A session's rows are folded in order in one stream; runs without
    a session or a start have no row.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, free = None, 0
        for pdf in batches:
            out = []
            for s, run, start, end in zip(pdf["session_id"], pdf["run_id"], pdf["started"], pdf["ended"], strict=True):
                if s != session:
                    session, free = s, start
                got = start >= free
                free = end if got else free
                out.append((s, run, got))
            yield pd.DataFrame(out, columns=["session_id", "run_id", "acquired"])

    return runs.where("session_id is not null and started is not null").select("session_id", "run_id", "started", "ended").repartition("session_id").sortWithinPartitions("session_id", "started", "run_id").mapInPandas(fold, "session_id long, run_id long, acquired boolean")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by event type; with a stream, rows later than the watermark are left out."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts by event type over windows that overlap: one starts every ``slide``."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def answered(questions: DataFrame, replies: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Questions (key, asked_at) with the replies (key, replied_at) that follow them in time; of streams, each side's state
    ends with its watermark."""
    left, right = questions.alias("q"), replies.alias("r")
    if questions.isStreaming:
        left = questions.withWatermark("asked_at", late).alias("q")
    if replies.isStreaming:
        right = replies.withWatermark("replied_at", late).alias("r")
    near = (F.col("r.replied_at") >= F.col("q.asked_at")) & (F.col("r.replied_at") <= F.col("q.asked_at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col("q.key") == F.col("r.key")) & near).select(F.col("q.key").alias("key"), "asked_at", "replied_at")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions by user: events with less than the gap between them."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
