"""Progress of sessions over events: as a window in batch, as keyed state in a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

# What an event sets.
STARTED, DETECTED, SECTION_STARTED, SECTION_DONE, DONE, FAILED = (
    "PaperProcessingStarted", "SectionDetected", "SectionProcessingStarted", "SectionProcessingCompleted", "PaperProcessingCompleted", "ExtractionFailed",
)
BASE, EACH, CAP = 0.1, 0.15, 0.9
STATUS = {STARTED: "started", DONE: "completed", FAILED: "failed"}
OTHER = "processing"

SCHEMA = "session string, event_id long, ts timestamp, event_type string, status string, sections_processed long, progress double"


def status(event_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, event_type), F.lit(OTHER))


def message(event_type: Column, section: Column, error: Column) -> Column:
    """What a session is told; the section and the error come from the event's own fields."""
    named = F.coalesce(section, F.lit("section"))
    return (
        F.when(event_type == STARTED, "Starting paper processing").when(event_type == DETECTED, "Detected paper sections")
        .when(event_type == SECTION_STARTED, F.concat(F.lit("Processing "), named)).when(event_type == SECTION_DONE, F.concat(F.lit("Completed "), named))
        .when(event_type == DONE, "Paper processing completed").when(event_type == FAILED, F.concat(F.lit("Extraction failed: "), F.coalesce(error, F.lit("Unknown error"))))
        .otherwise(F.concat(F.lit("Processing: "), event_type))
    )


def for_session(events: DataFrame, session: str) -> DataFrame:
    """Events that a session gets: its own, and those without an operation_id."""
    return events.filter(F.col("operation_id").isNull() | (F.col("operation_id") == session))


def session_progress(events: DataFrame) -> DataFrame:
    """``events`` (session, event_id, ts, event_type) with status, sections_processed and progress after each.

    Progress is the last value that an event has set, 0.0 at first; a new start does not reset the count.
    """
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("sections_processed", F.count_if(F.col("event_type") == SECTION_DONE).over(so_far))
    kind = F.col("event_type")
    value = (
        F.when(kind == STARTED, 0.0).when(kind == DETECTED, BASE).when(kind == DONE, 1.0)
        .when(kind == SECTION_DONE, F.least(F.lit(CAP), F.lit(BASE) + F.lit(EACH) * F.col("sections_processed")))
    )
    progress = F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.lit(0.0))
    return counted.select("session", "event_id", "ts", "event_type", status(kind).alias("status"), "sections_processed", progress.alias("progress"))


def step(kind: str, sections: int, progress: float) -> tuple[int, float]:
    """The state after one event."""
    if kind == SECTION_DONE:
        sections += 1
        return sections, min(CAP, BASE + EACH * sections)
    return sections, {STARTED: 0.0, DETECTED: BASE, DONE: 1.0}.get(kind, progress)


def stream_progress(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """The same over a stream. State is one count and one number per session, and goes after ``idle``.

    Events are taken in order of (ts, event_id) within a micro-batch.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sections, progress = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, ts, kind in rows[["event_id", "ts", "event_type"]].itertuples(index=False, name=None):
            sections, progress = step(kind, sections, progress)
            out.append((key[0], event_id, ts, kind, STATUS.get(kind, OTHER), sections, progress))
        state.update((sections, progress))
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["session", "event_id", "ts", "event_type", "status", "sections_processed", "progress"])

    return events.groupBy("session").applyInPandasWithState(run, SCHEMA, "sections long, progress double", "append", GroupStateTimeout.ProcessingTimeTimeout)


class InOrder(StatefulProcessor):
    """A session's events, put in order of (ts, event_id) by the watermark. State: what waits for it, the count, the progress, the last time."""

    def __init__(self, idle: int):
        self.idle = idle  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "sections long, progress double, last long")
        self.waiting = handle.getListState("waiting", "event_id long, ts long, event_type string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(batch["event_id"].astype(int), map(int, micros), batch["event_type"])))
            for at in sorted({-(-int(t) // 1000) for t in micros}):
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, in order; the state goes when a session has been idle."""
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((x for x in waiting if x[1] <= now * 1000), key=lambda x: (x[1], x[0]))
        sections, progress, last = self.done.get() if self.done.exists() else (0, 0.0, 0)
        if not ready:
            if not waiting and self.done.exists() and last + self.idle <= now:
                self.done.clear()
            return
        rest = [x for x in waiting if x[1] > now * 1000]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        out = []
        for event_id, ts, kind in ready:
            sections, progress = step(kind, sections, progress)
            out.append((key[0], event_id, pd.Timestamp(ts, unit="us"), kind, STATUS.get(kind, OTHER), sections, progress))
        last = ready[-1][1] // 1000
        self.done.update((sections, progress, last))
        self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame(out, columns=["session", "event_id", "ts", "event_type", "status", "sections_processed", "progress"])

    def close(self) -> None:
        pass


def ordered_progress(events: DataFrame, disorder: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """``session_progress`` of a stream whose events come out of order, by up to ``disorder``: each is told once the watermark has passed it.

    What waits is in list state, the count and the progress in value state, timers in event time wake both; a
    session's state goes when it has been idle for ``idle`` of event time. Needs RocksDB as the state store
    (``spark.sql.streaming.stateStore.providerClass``). Rows that come later than ``disorder`` are dropped by Spark.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.select("session", "event_id", "ts", "event_type").withWatermark("ts", disorder)
    return rows.groupBy("session").transformWithStateInPandas(InOrder(milliseconds), SCHEMA, "Append", "EventTime")


class Bus:
    """Handlers of event types and of all events, called for each micro-batch by one query.

    A handler gets the batch's events of exactly its type, then those of all types get all; each in order of
    registration. A handler's fault is a row of the log, and the others go on. The log also tells what a batch had
    reached when a query was stopped: handlers that have seen a batch are not called with it again.
    """

    LOG = "batch_id long, position int, handler string, event_type string, error string"

    def __init__(self) -> None:
        self.handlers: list[tuple[str, str | None, Callable[[DataFrame, int], None]]] = []

    def subscribe(self, event_type: str, handler: Callable[[DataFrame, int], None], name: str | None = None) -> Bus:
        self.handlers.append((name or getattr(handler, "__name__", "handler"), event_type, handler))
        return self

    def subscribe_all(self, handler: Callable[[DataFrame, int], None], name: str | None = None) -> Bus:
        self.handlers.append((name or getattr(handler, "__name__", "handler"), None, handler))
        return self

    def order(self) -> list[tuple[str, str | None, Callable[[DataFrame, int], None]]]:
        return [h for h in self.handlers if h[1] is not None] + [h for h in self.handlers if h[1] is None]

    def publish(self, batch: DataFrame, batch_id: int, log: str) -> None:
        """Hand one batch to all handlers that the log does not show to have had it."""
        spark = batch.sparkSession
        try:
            had = {(r["position"], r["handler"]) for r in spark.read.schema(self.LOG).parquet(log).filter(F.col("batch_id") == batch_id).select("position", "handler").collect()}
        except AnalysisException:  # no log yet
            had = set()
        batch.persist()
        try:
            for position, (name, event_type, handler) in enumerate(self.order()):
                if (position, name) in had:
                    continue
                error = None
                try:
                    handler(batch if event_type is None else batch.filter(F.col("event_type") == event_type), batch_id)
                except Exception as e:  # noqa: BLE001  one handler's fault is its row
                    error = f"{type(e).__name__}: {e}"
                spark.createDataFrame([(batch_id, position, name, event_type, error)], self.LOG).coalesce(1).write.mode("append").parquet(log)
        finally:
            batch.unpersist()

    def start(self, events: DataFrame, checkpoint: str, log: str, **trigger):
        return events.writeStream.foreachBatch(lambda batch, batch_id: self.publish(batch, batch_id, log)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def subscribe(events: DataFrame, event_type: str | None, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of one event type (or all) to ``handler``."""
    chosen = events if event_type is None else events.filter(F.col("event_type") == event_type)
    return chosen.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).start()


def to_session(progress: DataFrame, session: str, send: Callable[[str], None], checkpoint: str):
    """A sink for one session: each message as JSON, in order; an error ends the query. For all sessions there is ``sinks.to_sessions``."""

    def deliver(batch: DataFrame, _: int) -> None:
        rows = batch.filter(F.col("session") == session).orderBy("ts", "event_id").select(F.to_json(F.struct("*")).alias("m"))
        for r in rows.toLocalIterator():
            send(r["m"])

    return progress.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def log(events: DataFrame):
    return events.writeStream.format("console").start()


def retry_events(calls: DataFrame) -> DataFrame:
    """Rows of the event table for calls (call_id, attempts, error): attempted, succeeded (after a retry only), exhausted."""
    tried = calls.filter("attempts > 0").select("call_id", F.explode(F.sequence(F.lit(1), F.col("attempts"))).alias("attempt")).withColumn("event_type", F.lit("RetryAttempted"))
    good = calls.filter("error IS NULL AND attempts > 1").select("call_id", F.col("attempts").alias("attempt"), F.lit("RetrySucceeded").alias("event_type"))
    bad = calls.filter("error IS NOT NULL").select("call_id", F.col("attempts").alias("attempt"), F.lit("RetryExhausted").alias("event_type"))
    return tried.unionByName(good).unionByName(bad)
