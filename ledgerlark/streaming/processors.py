"""Keyed state with typed variables and event-time timers: token buckets and session locks that decide in the order of events.

A row waits in its key's list state until the watermark has passed it; a timer then decides all that wait, in the order of their
times, so that a stream gives the rows that the tables' functions of ``stateful`` give, however its rows are cut into
batches. Rows later than the watermark are nobody's. The state store has to be RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.commits import work_folder
from .stateful import BURST, take

#: A time after all others, in milliseconds: a row of that time closes a stream.
CLOSING = 1 << 42
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Waiting(StatefulProcessor):
    """Rows wait in list state; a timer at the least of their times fires once the watermark has passed it. What still waits then gets the
    next one, so a key has a timer for each batch and not for each row."""

    ROW = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.ROW)

    def wait(self, rows: Iterator[pd.DataFrame], columns: list[str], at: str) -> None:
        for pdf in rows:
            each = list(zip(*(pdf[c].tolist() for c in columns), strict=True))
            if each:
                self.rows.appendList(each)
                self.handle.registerTimer(int(pdf[at].min()))

    def due(self, watermark_ms: int, at: int, order) -> list[tuple]:
        """The rows that the watermark has passed, in order; the others go on waiting."""
        rows = [tuple(r) for r in self.rows.get()]
        now = sorted((r for r in rows if r[at] <= watermark_ms), key=order)
        later = [r for r in rows if r[at] > watermark_ms]
        if now:
            self.rows.clear()
            if later:
                self.rows.put(later)
                self.handle.registerTimer(min(r[at] for r in later))
        return now

    def close(self) -> None:
        pass


DECISION = "key long, at_ms long, allowed boolean, retry_after_sec int"


class TokenBuckets(Waiting):
    """A bucket for each key: tokens and the time of the last request, as value state."""

    ROW = "at_ms long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.bucket = handle.getValueState("bucket", "tokens double, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.wait(rows, ["at_ms"], "at_ms")
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.bucket.get() if self.bucket.exists() else (float(BURST), None)
        tokens, last, out = held[0], held[1], []
        for (at,) in self.due(timerValues.getCurrentWatermarkInMs(), 0, lambda r: r[0]):
            tokens, allowed, wait = take(tokens, at if last is None else last, at)
            last = at
            out.append((key[0], at, allowed, wait))
        if out:
            self.bucket.update((float(tokens), int(last)))
            yield pd.DataFrame(out, columns=["key", "at_ms", "allowed", "retry_after_sec"])


def rate_limited(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """A decision for each request (key, at_ms) of a stream, made in the order of their times once the watermark has passed them."""
    timed = requests.where("key is not null and at_ms is not null").select("key", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(TokenBuckets(), DECISION, "append", "eventTime")


EVENT = "session_id long, run_id long, at_ms long, event string"


class SessionLocks(Waiting):
    """One holder a session, as value state; runs that ask while it is held are counted by holder in map state. A held lock ends by its own
    timer, without a row that says so."""

    ROW = "run_id long, started long, ended long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.holder = handle.getValueState("holder", "run_id long, free_ms long")
        self.turned_away = handle.getMapState("turned_away", "run_id long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.wait(rows, ["run_id", "started", "ended"], "started")
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, out, refused = timerValues.getCurrentWatermarkInMs(), [], 0
        before = holder = tuple(self.holder.get()) if self.holder.exists() else None
        for run, start, end in self.due(watermark, 1, lambda r: (r[1], r[0])):
            if holder and holder[1] <= start:
                out.append((key[0], *holder, "expired"))
                holder = None
            if holder is None:
                holder, refused = (run, end), 0
                out.append((key[0], run, start, "acquired"))
            else:
                refused += 1
                out.append((key[0], run, start, "refused"))
        if holder and holder[1] <= watermark:
            out.append((key[0], *holder, "expired"))
            holder = None
        if holder != before:
            self.turned_away.clear()
            if holder:
                self.holder.update(holder)
                self.handle.registerTimer(holder[1])
            else:
                self.holder.clear()
        if holder and refused:
            known = (holder[0],)
            self.turned_away.updateValue(known, (refused + (self.turned_away.getValue(known)[0] if self.turned_away.containsKey(known) else 0),))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "run_id", "at_ms", "event"])


def session_locks(runs: DataFrame, late: str = "1 minute") -> DataFrame:
    """(session_id, run_id, at_ms, event) for a stream of runs (session_id, run_id, started, ended): a run acquires its session's lock, is
    refused, or its lock has expired; the first two in the order of their starts, as in the table's form."""
    given = runs.where("session_id is not null and started is not null").select("session_id", "run_id", "started", "ended", F.timestamp_millis("started").alias("at")).withWatermark("at", late)
    return given.groupBy("session_id").transformWithStateInPandas(SessionLocks(), EVENT, "append", "eventTime")


def replayed(rows: DataFrame, at: str, closing: tuple, stream: Callable[[DataFrame], DataFrame], batches: int = 3) -> DataFrame:
    """What ``stream`` gives for a table whose rows come in batches, in the order of the number ``at``, and then the row ``closing``.

    The stream is started anew for each batch and goes on from its checkpoint. The rows, the checkpoint and the output are kept in
    the shared folder.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    bounds = rows.approxQuantile(at, [k / batches for k in range(1, batches)], 0.001) if batches > 1 else []
    place = F.lit(0)
    for bound in bounds:
        place = place + F.coalesce(F.col(at) >= bound, F.lit(False)).cast("int")
    parts = [rows.where(place == k) for k in range(batches)] + [spark.createDataFrame([closing], rows.schema)]
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/in")
            given = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            running = stream(given).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            running.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.parquet(f"{folder}/out")
