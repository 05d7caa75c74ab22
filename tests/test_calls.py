"""Calls: limits, time-outs, retries, what is kept, and the events they make."""

import asyncio
import time

import pytest
from pyspark.sql import functions as F

from scholion.operators import annotate as ann
from scholion.operators import calls

QUIET = dict(sleep=lambda _: None)


def run(client, texts, policy=None, pace=None):
    pace = pace or calls.Pace()
    return asyncio.run(calls.together(client, texts, policy or ann.RetryPolicy(**QUIET), pace, calls.Bucket(pace)))


class Slow:
    """Counts the calls under way; those that were cancelled."""

    def __init__(self, seconds):
        self.seconds, self.now, self.most, self.cancelled, self.made = seconds, 0, 0, 0, 0

    async def annotate(self, text):
        self.now, self.made = self.now + 1, self.made + 1
        self.most = max(self.most, self.now)
        try:
            await asyncio.sleep(self.seconds)
            return f" {text}! "
        except asyncio.CancelledError:
            self.cancelled += 1
            raise
        finally:
            self.now -= 1


def test_calls_are_bounded_and_in_order():
    client = Slow(0.02)
    got = run(client, ["a", "", None, "b", " "] + [str(k) for k in range(12)], pace=calls.Pace(in_flight=3))
    assert [x[0] for x in got] == ["a!", "", "", "b!", ""] + [f"{k}!" for k in range(12)]
    assert client.most == 3 and client.made == 14 and got[1][1] == [] and [a[0] for a in got[0][1]] == [1]


def test_time_outs_cancel():
    client = Slow(30)
    began = time.time()
    got = run(client, ["a", "b"], ann.RetryPolicy(attempts=2, timeout=0.05, **QUIET))
    assert time.time() - began < 10 and client.cancelled == 4 and client.now == 0
    assert [x[0] for x in got] == [None, None] and all(x[2].startswith("TimeoutError") and len(x[1]) == 2 for x in got)

    class Plain:
        def annotate(self, text):
            time.sleep(0.3)
            return text

    assert run(Plain(), ["a"], ann.RetryPolicy(attempts=1, timeout=0.02, **QUIET))[0][2].startswith("TimeoutError")
    assert run(Plain(), ["a"], ann.RetryPolicy(attempts=1, timeout=5, **QUIET))[0][0] == "a" and run(Plain(), ["a"])[0][0] == "a"


def test_tokens_come_back_at_their_rate():
    at = [0.0]
    bucket = calls.Bucket(calls.Pace(per_second=2, burst=3), lambda: at[0])
    assert [bucket.wait() for _ in range(5)] == [0, 0, 0, 0.5, 1.0]
    at[0] = 1.0
    assert bucket.wait() == pytest.approx(0.5)
    at[0] = 100.0
    assert [bucket.wait() for _ in range(4)] == [0, 0, 0, 0.5]
    began = time.time()
    run(Slow(0), [str(k) for k in range(6)], pace=calls.Pace(in_flight=6, per_second=20))
    assert time.time() - began >= 0.24


ROWS = [(1, 1, "fine"), (1, 2, "once more"), (2, 1, "always"), (3, 1, "never"), (4, 1, "always"), (4, 2, "good"), (5, 1, " "), (6, 1, None)]
SCHEMA = "doc int, chunk_index int, chunk string"


def test_attempts_events_and_documents(spark):
    class Faulty:
        async def annotate(self, text):
            if text.startswith("never"):
                raise ValueError("bad")
            if text.startswith("always") or text.startswith("once") and calls.ATTEMPT.get() == 1:
                raise RuntimeError("rate limit")
            return text.upper()

    df = spark.createDataFrame(ROWS, SCHEMA)
    called = calls.call(df, Faulty, ann.RetryPolicy(attempts=3, **QUIET)).cache()
    of = {(r["doc"], r["chunk_index"]): r for r in called.collect()}
    assert of[1, 1]["answer"] == "FINE" and of[5, 1]["answer"] == of[6, 1]["answer"] == "" and of[2, 1]["answer"] is None and of[3, 1]["error"] == "ValueError: bad"
    assert {k: len(r["attempts"]) for k, r in of.items()} == {(1, 1): 1, (1, 2): 2, (2, 1): 3, (3, 1): 1, (4, 1): 3, (4, 2): 1, (5, 1): 0, (6, 1): 0}
    events = sorted((r["doc"], r["chunk_index"], r["event_type"], r["attempt"], r["delay"], r["error_type"]) for r in calls.attempt_events(called, ["doc", "chunk_index"]).collect() if r["seconds"] is not None)
    tries = lambda d, c: [(d, c, "RetryAttempted", 1, 2.0, "RuntimeError"), (d, c, "RetryAttempted", 2, 4.0, "RuntimeError"), (d, c, "RetryExhausted", 3, None, "RuntimeError")]
    assert events == [(1, 2, "RetryAttempted", 1, 2.0, "RuntimeError"), (1, 2, "RetrySucceeded", 2, None, None), *tries(2, 1), (3, 1, "RetryExhausted", 1, None, "ValueError"), *tries(4, 1)]
    docs = {r["doc"]: (r["n_chunks"], r["failed_chunks"], r["error"], r["marked_text"]) for r in calls.merged(called, ["doc"]).collect()}
    assert docs == {1: (2, 0, None, "FINE\n\nONCE MORE"), 2: (1, 1, "RuntimeError: rate limit", None), 3: (1, 1, "ValueError: bad", None), 4: (2, 1, None, "always\n\nGOOD"), 5: (1, 0, None, ""), 6: (1, 0, None, "")}
    assert calls.call(df.limit(0), Faulty).count() == 0


def test_waves_do_not_pay_twice(spark, tmp_path):
    path, log = f"file://{tmp_path}/answers", str(tmp_path / "log")
    df = spark.createDataFrame([(k, f"text {k}") for k in range(40)] + [(99, None)], "id int, chunk string")

    bad = df.filter(F.pmod(F.xxhash64("id"), F.lit(6)) == 3).first()["chunk"]  # neither in the first wave nor in the last

    class Logged:
        def __init__(self, stops=True):
            self.stops = stops

        def annotate(self, text):
            with open(log, "a") as f:
                f.write(text + "\n")
            if text == bad and self.stops:
                raise SystemError("the task is lost")
            return text.upper()

    made = lambda: sorted(open(log).read().split("\n")[:-1])  # noqa: E731, SIM115
    fatal = ann.RetryPolicy(attempts=1, on=(KeyError,), never=(ValueError,), **QUIET)
    with pytest.raises(Exception, match="the task is lost"):
        calls.call_in_waves(df, ["id"], path, Logged, fatal, waves=6)
    before = made()
    assert 0 < len(set(before)) < 40
    kept = {r["id"] for r in calls.finished(spark, path).collect()}
    out = {r["id"]: r["answer"] for r in calls.call_in_waves(df, ["id"], path, lambda: Logged(False), fatal, waves=6).collect()}
    assert out == {k: f"TEXT {k}" for k in range(40)} | {99: ""}
    again = [x for x in made() if made().count(x) > before.count(x) and x in before]
    assert not {f"text {k}" for k in kept} & set(again)  # what was kept was not called again
    n = len(made())
    assert calls.call_in_waves(df, ["id"], path, lambda: Logged(False), fatal, waves=6).count() == 41 and len(made()) == n


def test_elements_come_with_the_annotation(spark):
    docs = spark.createDataFrame([(1, "Our goal is x. We use y."), (2, None), (3, "")], "id long, t string")
    from scholion.functions import markup

    a = ann.annotate(docs, "id", "t", with_elements=True)
    both = a.select("elements", markup.elements(markup.without_summaries(F.col("marked_text"))).alias("e")).collect()
    assert all(r["elements"] == r["e"] for r in both) and sorted(len(r["e"]) for r in both) == [0, 0, 2]


def test_section_events(spark):
    df = spark.createDataFrame([("a", 10, 2, 7, 0.5)], "id string, size int, n int, tokens int, s double")
    got = [tuple(r) for r in calls.section_events(df, ["id"], F.col("size"), F.col("n"), F.col("tokens"), F.col("s")).collect()]
    assert got == [("a", "SectionProcessingStarted", 10, None, None, None), ("a", "SectionProcessingCompleted", None, 2, 7, 0.5)]
