"""Markup, elements, metrics, errors, annotation, pages, configuration, progress."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from scholion.functions import html as tree
from scholion.functions import markup
from scholion.operators import annotate as ann
from scholion.operators import elements as el
from scholion.operators import errors, metrics
from scholion.sources import config as conf
from scholion.sources import documents as src
from scholion.streaming import progress


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("o")).first()["o"]


def test_markup(spark):
    s = "a<summary> one\n</summary>b<summary>two</summary>"
    assert one(spark, markup.summary, s) == "one" and one(spark, markup.without_summaries, s) == "ab" and one(spark, markup.all_summaries, s) == ["one", "two"]
    nested = "<method>a <goal confidence='0.7'>b &lt;</goal></method>"
    assert [tuple(e) for e in one(spark, markup.elements, nested)] == [("method", "0.00", "a b <"), ("goal", "0.7", "b <")]
    assert one(spark, lambda c: markup.hide(c, "goal"), nested) == "<method>a b &lt;</method>"
    assert one(spark, markup.confidences_valid, '<goal confidence="0.40">x</goal>') is False
    html = '<h1 id="top">A</h1><h2> </h2><h3>B <b>c</b></h3>'
    assert [tuple(t) for t in one(spark, tree.toc, html)] == [("top", "A", 1), ("heading-1", "B c", 3)]
    assert one(spark, markup.without_active, '<p onclick="x()">a</p><script>b</script><!-- c --><a href="javascript:d">e</a>') == "<p>a</p><a >e</a>"
    assert one(spark, markup.slug, "A  b: C!") == "academic-paper-a-b-c"


def test_element_rules(spark):
    good = {"element_type": "goal", "text": "t", "evidence_type": "mixed", "confidence": 1}
    check = lambda e: one(spark, el.response_error, json.dumps({"elements": [good, e]}))
    assert check(good) is None and check("x") == "element_format"
    assert check({k: v for k, v in good.items() if k != "text"}) == "missing_required_field"
    assert check(good | {"element_type": "x"}) == "invalid_element_type" and check(good | {"evidence_type": 3}) == "invalid_evidence_type"
    assert check(good | {"confidence": "0.5"}) == check(good | {"confidence": 1.5}) == "invalid_confidence" and check(good | {"confidence": True}) is None
    assert check(good | {"text": " "}) == check(good | {"text": 5}) == "invalid_text"
    assert one(spark, el.response_error, "[]") == "response_format" and one(spark, el.response_error, "{}") == "response_field"
    assert one(spark, el.summary_error, '{"summary": "s", "confidence": 0.5, "source_sections": []}') is None
    assert one(spark, el.summary_error, '{"summary": "s", "confidence": 0.5, "source_sections": "x"}') == "response_field"


def test_element_frames(spark):
    rows = [("e1", "p", "s", None, "goal", "unknown", "text", 0.7), ("e2", "p", "s", 1, "x", "unknown", " ", 0.2), ("e3", "q", "s", 2, "result", "mixed", "t", None), ("", "p", "s", 0, "goal", "mixed", "t", 0.1)]
    df = spark.createDataFrame(rows, "element_id string, paper_id string, section_id string, page_number int, element_type string, evidence_type string, text string, confidence double")
    good, bad = el.quarantine(df, "element")
    assert [r["element_id"] for r in good.collect()] == ["e1"]
    assert {r["element_id"]: r["violations"] for r in bad.collect()} == {"e2": ["element.type", "element.text"], "e3": ["element.confidence"], "": ["element.ids", "element.page"]}
    assert el.by_confidence(df, 0.7).count() == 1 and el.by_type(df, "goal", "result").count() == 3
    assert tuple(el.type_counts(df.limit(0)).first()) == (0, 0, 0, 0) and el.average_confidence(df.limit(0)).first()[0] == 0.0
    assert el.orphans(df, df.filter("paper_id = 'p'")).count() == 1


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "provider string, model string, tokens long, seconds double, success boolean, error_type string")
    assert tuple(metrics.usage_summary(empty).first()) == (0, 0, 0, 0, 0.0, 0.0)
    unknown = spark.createDataFrame([("x", "none", 1000, 1.0, True, None)], empty.schema)
    assert metrics.usage_summary(unknown).first()["cost"] == pytest.approx(0.01)
    counts = metrics.errors_by_type(unknown.withColumn("error_type", F.lit("t")))
    assert metrics.as_map(counts, "error_type", "n", "m").first()["m"] == {"t": 1}


def test_errors(spark):
    c = one(spark, errors.classify, "RateLimitError", "nothing known")
    assert (c["category"], c["retry_strategy"], c["confidence"]) == ("api_provider", "exponential_backoff", 0.98)
    c = one(spark, errors.classify, "SomethingElse", "Out of memory")
    assert (c["category"], c["is_retriable"]) == ("system_resource", False)
    c = one(spark, errors.classify, "ApiKeyError", "request timed out")
    assert (c["category"], c["severity"], c["is_retriable"], c["confidence"]) == ("retriable", "critical", False, 0.98)
    assert c["remediation_steps"] == sorted(c["remediation_steps"]) and c["metadata"] == {"config_issue": "api_key", "timeout_issue": "true", "pattern_match": "timeout"}
    assert one(spark, errors.classify, "GeminiAuthenticationError", "x")["user_message"] == "API key is invalid or missing"
    assert one(spark, errors.user_message, "API broke")["title"] == "API Error"
    delays = [ann.RetryPolicy(initial=1.0).delay(k) for k in range(6)]
    assert delays == [1, 2, 4, 8, 16, 30]
    got = spark.range(6).select(errors.retry_delay(F.lit("exponential_backoff"), F.col("id"), 1.0).alias("d")).collect()
    assert [r["d"] for r in got] == delays
    assert one(spark, errors.http_status, "TextLengthMismatch") == 422 and one(spark, errors.retryable, "GeminiSafetyFilterError") is False


def test_annotation(spark):
    class Broken:
        def annotate(self, text):
            raise RuntimeError("rate limit")

    docs = spark.createDataFrame([(1, "Our goal is x. We use y. The result is z."), (2, ""), (3, None), (4, "This is a test paper. " * 1000)], "id long, t string")
    out = {r["id"]: r for r in ann.annotate(docs, "id", "t").collect()}
    assert '<goal confidence="0.85">Our goal is x.</goal>' in out[1]["marked_text"] and out[2]["marked_text"] == out[3]["marked_text"] == ""
    assert out[4]["n_chunks"] == 2 and out[4]["failed_chunks"] == 0
    policy = ann.RetryPolicy(attempts=2, strategy="immediate")
    bad = {r["id"]: r for r in ann.annotate(docs, "id", "t", Broken, policy).collect()}
    assert bad[1]["failed_chunks"] == 1 and bad[1]["marked_text"].startswith("Our goal")
    calls = ann.annotate_chunks(docs.withColumnRenamed("t", "chunk"), Broken, policy)
    assert {r["id"]: r["attempts"] for r in calls.collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    events = progress.retry_events(calls.withColumnRenamed("id", "call_id"))
    assert events.filter("event_type = 'RetryExhausted'").count() == 2 and events.count() == 6
    with pytest.raises(ValueError):
        ann.annotator("nothing")
    reply = ann.respond(ann.annotate(docs, "id", "t"), "id").filter("id = 1").first()
    assert len(reply["paper_id"]) == 8 and reply["summary"].startswith("Our goal") and "<summary>" not in reply["text_with_markup"]
    assert one(spark, lambda a, b: ann.paper_summary(a, b, F.lit("s")), " ", None)["confidence"] == 0.0


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page one " * 30)
    (tmp_path / "b.pdf").write_bytes(b"locked")
    (tmp_path / "c.txt").write_bytes(b"x")

    def parse(content):
        if content == b"locked":
            raise ValueError("needs a password")
        return [(content.decode(), 100.0, 200.0)]

    files = src.scan_files(spark, str(tmp_path))
    assert {r["path"][-5:]: r["status"] for r in files.collect()} == {"a.pdf": "ok", "b.pdf": "ok", "c.txt": "invalid_type"}
    pages = {r["path"][-5:]: r for r in src.scan_pages(files, parse).collect()}
    assert pages["a.pdf"]["char_count"] == 270 and pages["b.pdf"]["error"] == "PasswordProtectedError"
    assert one(spark, lambda c: src.page_text(F.from_json(c, "array<array<string>>")), '[[""], ["a", "b"], ["c\\n"], []]') == "ab\nc\n"
    assert src.health(spark).first()["status"] == "healthy"


def test_configuration(tmp_path):
    given = {"api": {"provider_type": "openai", "openai_api_key": "k"}, "analysis": {"temperature": "0.3"}}
    c = conf.from_mapping(given, env={})
    assert (c.analysis.temperature, c.extraction.max_file_size_mb, c.retry.max_delay_seconds) == (0.3, 50, 30.0) and conf.has_valid_key(c)
    for bad in ({"api": {"provider_type": "x"}}, {"api": {"openai_api_key": "k"}}, given | {"analysis": {"temperature": 2.0}}, {"api": {"provider_type": "openai", "openai_api_key": conf.PLACEHOLDER}}):
        with pytest.raises(conf.ConfigurationError):
            conf.from_mapping(bad, env={})
    with pytest.raises(conf.ConfigurationError):
        conf.from_mapping(given, strict=True, env={})
    assert conf.from_mapping({}, env={"GEMINI_API_KEY": "k"}).api.keys == {"gemini": "k"}
    path = tmp_path / "c.json"
    path.write_text("[1]")
    with pytest.raises(conf.ConfigurationError):
        conf.load(path)
    path.write_text(json.dumps({"system": "S", "rules": ["r1", "r2"]}))
    assert conf.load_prompts(path).rules == ("r1", "r2")
    with pytest.raises(AttributeError):
        c.log_level = "x"


def test_streaming_equals_batch(spark, tmp_path):
    kinds = [progress.STARTED, progress.DETECTED, *[progress.SECTION_DONE] * 7, progress.FAILED, "Other", progress.DONE]
    rows = [(f"s{k % 2}", k, dt.datetime(2024, 1, 1, 0, 0, k), kinds[(k // 2) % len(kinds)]) for k in range(40)]
    events = spark.createDataFrame(rows, "session string, event_id long, ts timestamp, event_type string")
    batch = progress.session_progress(events).select(*[c.split()[0] for c in progress.SCHEMA.split(", ")])
    for part, (a, z) in enumerate(((0, 15), (15, 40))):
        events.filter((F.col("event_id") >= a) & (F.col("event_id") < z)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = progress.stream_progress(stream).writeStream.format("memory").queryName("progress_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [tuple(r) for r in spark.table("progress_out").orderBy("event_id").collect()]
    assert [(*r[:-1], round(r[-1], 9)) for r in got] == [(*tuple(r)[:-1], round(r["progress"], 9)) for r in batch.orderBy("event_id").collect()]
    assert max(r[-2] for r in got) >= 7 and progress.CAP in {round(r[-1], 9) for r in got}


def test_tags_in_document_order():
    text = "x</goal><RESULT confidence=''>r <result confidence='0.6'>s</result> t</RESULT><b>u</b><goal confidence=\"0.9\">v<method>w</goal>y"
    assert markup.collect(text) == [("result", "0.00", "r s t"), ("result", "0.6", "s"), ("goal", "0.9", "vw"), ("method", "0.00", "w")]
    assert markup.collect("<goal>a<goal>b") == [("goal", "0.00", "ab"), ("goal", "0.00", "b")] and markup.collect("") == []
    assert markup.collect("<goals>a</goals>") == [] and len(markup.collect("<goal>" * 2000 + "</goal>" * 2000)) == 2000


def test_output_tokens_floor_the_sum(spark):
    df = spark.createDataFrame([(["abc", "abc"],), ([],), ([None, "abcdefgh"],)], "t array<string>")
    assert [r[0] for r in df.select(metrics.output_tokens(F.col("t"))).collect()] == [1, 0, 2]


def test_prompts_numbered_and_environment():
    p = ann.Prompts(rules=("a", "b"), numbered=True)
    assert "1. a\n2. b" in p.frame()[1] + p.frame()[0]
    assert conf.env_flag("D", {"D": "Yes"}) and not conf.env_flag("D", {}) and not conf.env_flag("D", {"D": "0"})
    env = {"DEBUG": "1", "SCHOLION_LOG_LEVEL": "WARN", "GEMINI_API_KEY": "k", "OPENAI_API_KEY": ""}
    assert conf.from_env(env) == {"debug": True, "config_path": None, "log_level": "WARN", "keys": {"gemini": "k"}}
    assert str(conf.resolve("a", "/b")) == "/b/a" and str(conf.resolve("/a", "/b")) == "/a"


def test_attempts_time_out():
    import time

    slow = ann.RetryPolicy(attempts=2, initial=0.0, timeout=0.05)
    got, tries, error = slow.run(lambda: time.sleep(0.4) or "late")
    assert (got, tries) == (None, 2) and "Timeout" in error
    assert ann.RetryPolicy(timeout=5.0).run(lambda: "ok") == ("ok", 1, None)


def test_scan_tells_its_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10)

    def parse(content):
        return [("w" * 200, 1.0, 2.0)]

    parse.version = "p1"
    row = src.scan_pages(src.scan_files(spark, str(tmp_path)), parse).first()
    assert (row["file_bytes"], row["parser"], row["page_number"]) == (10, "p1", 1) and row["seconds"] >= 0


def test_newline_position(spark):
    from scholion.functions.charmap import newline_position

    r = spark.range(1).select(newline_position(F.lit(7), F.lit(2), F.lit(9.5)).alias("p")).first()["p"]
    assert (r["char_index"], r["page_number"], r["x"], r["y"]) == (7, 2, 0.0, 9.5) and tuple(r["bbox"]) == (0.0, 9.5, 0.0, 9.5)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "# A\n\ntext"), (2, "# B")], "id long, m string")
    src.write_markdown(df, "m", str(tmp_path / "md"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "md").glob("part-*")).split("\f")[:-1]) == ["# A\n\ntext", "# B"]
    assert json.loads(src.to_json(df).filter("value LIKE '%B%'").first()[0]) == {"id": 2, "m": "# B"}


def test_streaming_bus_and_session_sink(spark, tmp_path):
    rows = [("s", k, dt.datetime(2024, 1, 1, 0, k), kind) for k, kind in enumerate((progress.STARTED, progress.SECTION_DONE, progress.DONE))] + [("t", 9, dt.datetime(2024, 1, 1), progress.FAILED)]
    spark.createDataFrame(rows, "session string, event_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("session string, event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    seen, sent = [], []
    q = progress.subscribe(stream(), progress.DONE, lambda batch, _: seen.extend(r["event_id"] for r in batch.collect()), str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert seen == [2]
    q = progress.to_session(stream(), "s", sent.append, str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert [json.loads(m)["event_id"] for m in sent] == [0, 1, 2]
