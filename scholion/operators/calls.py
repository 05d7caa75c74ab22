"""Calls of an annotator from the tasks of Spark: bounded, paced, timed out, tried again, and told about.

Each task runs one event loop per batch of rows: up to ``in_flight`` calls at once, no more a second than a token
bucket gives, each attempt with a time-out that cancels it. An annotator whose ``annotate`` is a coroutine is awaited, so
its attempt ends when it is cancelled; a plain one runs in a thread if it has a time-out (Python can't end that
thread, which is left behind) and directly if not. Every call keeps its attempts, from which ``attempt_events`` makes
rows of the event table.

``call_in_waves`` keeps what is paid for: calls are dealt into waves by a hash of their ids, each wave's answers are
appended to a table when it is done, and what the table has is not called again. A lost executor repeats the tasks
it had not finished, a lost driver the wave.

Defined cases: a blank or null text is no call: its answer is '' and it has no attempts; a call whose attempts
all fail has a null answer and an error; ids of calls should be unique, else equal ones share an answer in waves;
empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import asyncio
import contextvars
import inspect
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.batches import small_batches
from .annotate import Annotator, RetryPolicy, analyze_section

ATTEMPTS = "array<struct<attempt:int,error_type:string,error_message:string,delay:double,seconds:double>>"
#: The number of the attempt that is being made, from 1; annotators may read it.
ATTEMPT: contextvars.ContextVar[int] = contextvars.ContextVar("attempt", default=1)


@dataclass(frozen=True)
class Pace:
    """Limits of one task: calls at once, calls a second (none if null), and how many may come at once after a rest."""

    in_flight: int = 4
    per_second: float | None = None
    burst: int = 1


class Bucket:
    """Tokens that come back at a rate; ``take`` waits for one."""

    def __init__(self, pace: Pace, clock: Callable[[], float] = time.monotonic):
        self.rate, self.burst, self.clock = pace.per_second, max(1, pace.burst), clock
        self.tokens, self.at = float(self.burst), clock()

    def wait(self) -> float:
        """Take a token, also one that is still to come: seconds until it is there."""
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
        self.at = now
        return max(0.0, -self.tokens / self.rate)

    async def take(self) -> None:
        if self.rate and (seconds := self.wait()) > 0:
            await asyncio.sleep(seconds)


async def once(client: Annotator, text: str, timeout: float | None) -> str:
    """One attempt; a time-out cancels it."""
    if inspect.iscoroutinefunction(client.annotate):
        call = client.annotate(text)
    elif timeout:
        call = asyncio.to_thread(client.annotate, text)
    else:
        return client.annotate(text).strip()
    return (await (asyncio.wait_for(call, timeout) if timeout else call)).strip()


async def tried(client: Annotator, text: str, policy: RetryPolicy, bucket: Bucket) -> tuple[str | None, list[tuple], str | None]:
    """(answer, attempts, error). An attempt: its number, its fault if it failed, the delay after it if another follows, its seconds."""
    attempts: list[tuple] = []
    for number in range(policy.attempts):
        await bucket.take()
        ATTEMPT.set(number + 1)
        began = time.perf_counter()
        try:
            answer = await once(client, text, policy.timeout)
            attempts.append((number + 1, None, None, None, time.perf_counter() - began))
            return answer, attempts, None
        except (*policy.never, *policy.on) as e:
            last = isinstance(e, policy.never) or number + 1 == policy.attempts
            delay = None if last else policy.delay(number, e)
            attempts.append((number + 1, type(e).__name__, str(e), delay, time.perf_counter() - began))
            if last:
                return None, attempts, f"{type(e).__name__}: {e}"
            if policy.sleep is time.sleep:
                await asyncio.sleep(delay)
            else:
                policy.sleep(delay)
    return None, attempts, None


async def together(client: Annotator, texts: list, policy: RetryPolicy, pace: Pace, bucket: Bucket) -> list[tuple]:
    """``tried`` for each text, in order; blank ones are not called."""
    free = asyncio.Semaphore(pace.in_flight)

    async def one(text) -> tuple:
        if not (isinstance(text, str) and text.strip()):
            return "", [], None
        async with free:
            return await tried(client, text, policy, bucket)

    return await asyncio.gather(*map(one, texts))


def call(chunks: DataFrame, make: Callable[[], Annotator], policy: RetryPolicy | None = None, pace: Pace | None = None, text_col: str = "chunk") -> DataFrame:
    """``chunks`` with answer, attempts and error. One annotator and one bucket for each task; ``repartition`` before bounds how many tasks call."""
    policy, pace = policy or RetryPolicy(), pace or Pace()
    added = T.StructType.fromDDL(f"answer string, attempts {ATTEMPTS}, error string")
    names = ("attempt", "error_type", "error_message", "delay", "seconds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket = None, Bucket(pace)
        for batch in batches:
            client = client or make()
            rows = asyncio.run(together(client, list(batch[text_col]), policy, pace, bucket))
            told = [[dict(zip(names, x, strict=True)) for x in r[1]] for r in rows]
            yield batch.assign(answer=pd.Series([r[0] for r in rows], dtype=object, index=batch.index), attempts=pd.Series(told, dtype=object, index=batch.index), error=pd.Series([r[2] for r in rows], dtype=object, index=batch.index))

    small_batches(chunks.sparkSession)
    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, *added.fields]))


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def call_in_waves(chunks: DataFrame, keys: list[str], path: str, make: Callable[[], Annotator], policy: RetryPolicy | None = None, pace: Pace | None = None, text_col: str = "chunk", waves: int = 8) -> DataFrame:
    """``call`` with the answers kept under ``path`` wave by wave; what is there is not called again, faults included."""
    spark = chunks.sparkSession
    for wave in range(waves):
        todo = chunks.filter(F.pmod(F.xxhash64(*keys), F.lit(waves)) == wave)
        done = finished(spark, path)
        if done is not None:
            todo = todo.join(done.select(*keys), keys, "left_anti").select(*chunks.columns)
        call(todo, make, policy, pace, text_col).drop(text_col).write.mode("append").parquet(path)
    answers = finished(spark, path).select(*keys, "answer", "attempts", "error").dropDuplicates(keys)
    return chunks.join(answers, keys).select(*chunks.columns, "answer", "attempts", "error")


def attempt_events(called: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the event table from the attempts of calls: event_type, attempt, delay, error_type, error_message, seconds (of the call so far).

    RetryAttempted after each failed attempt that another follows, RetrySucceeded if a later one succeeds, RetryExhausted if none does.
    """
    x = F.col("x")
    upto = lambda i: F.aggregate(F.slice("attempts", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["seconds"] + F.coalesce(y["delay"], F.lit(0.0)))
    numbered = F.transform("attempts", lambda y, i: F.struct(y["attempt"].alias("attempt"), y["delay"].alias("delay"), y["error_type"].alias("error_type"), y["error_message"].alias("error_message"), upto(i).alias("seconds")))
    each = called.select(*keys, F.explode(numbered).alias("x"))
    kind = F.when(x["delay"].isNotNull(), "RetryAttempted").when(x["error_type"].isNotNull(), "RetryExhausted").when(x["attempt"] > 1, "RetrySucceeded")
    return each.select(*keys, kind.alias("event_type"), "x.attempt", "x.delay", "x.error_type", "x.error_message", "x.seconds").filter("event_type IS NOT NULL")


def merged(called: DataFrame, keys: list[str], index_col: str = "chunk_index", text_col: str = "chunk") -> DataFrame:
    """One row per document: keys, n_chunks, failed_chunks, error, marked_text, calls (chunk, attempts, error; in order).

    A failed chunk of several stays unmarked. Where a document is one call and that fails, the document has: no
    marked text and the call's error, as a caller of that one call would have.
    """
    body = F.struct(F.col(index_col).alias("chunk"), F.coalesce("answer", text_col).alias("text"), "attempts", "error")
    rows = called.groupBy(*keys).agg(F.array_sort(F.collect_list(body), lambda a, b: a["chunk"] - b["chunk"]).alias("rows"))
    lost = (F.size("rows") == 1) & F.get("rows", F.lit(0))["error"].isNotNull()
    return rows.select(
        *keys, F.size("rows").alias("n_chunks"), F.size(F.filter("rows", lambda r: r["error"].isNotNull())).alias("failed_chunks"), F.when(lost, F.get("rows", F.lit(0))["error"]).alias("error"),
        F.when(~lost, F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")).alias("marked_text"), F.transform("rows", lambda r: F.struct(r["chunk"].alias("chunk"), r["attempts"].alias("attempts"), r["error"].alias("error"))).alias("calls"),
    )


def section_events(sections: DataFrame, keys: list[str], size: Column, elements: Column, tokens: Column, seconds: Column) -> DataFrame:
    """The two events of each analysed section: SectionProcessingStarted with its size, SectionProcessingCompleted with what was found."""
    none = F.lit(None)
    started = F.struct(F.lit("SectionProcessingStarted").alias("event_type"), size.cast("long").alias("section_size_chars"), none.cast("long").alias("elements_extracted"), none.cast("long").alias("tokens_used"), none.cast("double").alias("duration_seconds"))
    done = F.struct(F.lit("SectionProcessingCompleted").alias("event_type"), none.cast("long").alias("section_size_chars"), elements.cast("long").alias("elements_extracted"), tokens.cast("long").alias("tokens_used"), seconds.cast("double").alias("duration_seconds"))
    return sections.select(*keys, F.explode(F.array(started, done)).alias("e")).select(*keys, "e.*")


def call_section_events(called: DataFrame, keys: list[str], text_col: str = "section_text") -> DataFrame:
    """``section_events`` of sections that have been called: elements of the answer, tokens of both, seconds of the attempts."""
    found = called.select(*keys, F.coalesce(F.length(text_col), F.lit(0)).alias("size"), "attempts", analyze_section(F.coalesce(text_col, F.lit("")), F.coalesce("answer", F.lit(""))).alias("a"))
    seconds = F.aggregate("attempts", F.lit(0.0), lambda s, x: s + x["seconds"] + F.coalesce(x["delay"], F.lit(0.0)))
    return section_events(found, keys, F.col("size"), F.size("a.elements"), F.col("a.input_tokens") + F.col("a.output_tokens"), seconds)
