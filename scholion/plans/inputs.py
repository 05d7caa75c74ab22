"""Inputs derived from the driver's tables, alike in Spark and (as text) in DuckDB.

The tables have no hyphenated line breaks, citations, tags or usage records, so queries first derive
such inputs by plain replacement and concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; what the queries hand to Python of it goes in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of up to so many bytes may be one row group, which one task reads whatever the size of the splits.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; a larger one as it lies. The size is the plan's own estimate, so nothing is listed or read for it."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) <= SMALL_BYTES else df


#: Bytes of a table, as the plan estimates them, for each task that makes and parses files.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A table over as many tasks as its size asks for, and all cores at least, however few files and row groups it has: for long work on each row."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def noisy(c: Column) -> Column:
    for a, b in ((".\n", ".\n\n"), (", ", ",  "), ("tion ", "ti-\non ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


NOISY = "replace(replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), ', ', ',  '), 'tion ', 'ti-' || chr(10) || 'on ')"
CITATION = " (Smith et  al. 2023) [1,  2]"


def cited(c: Column) -> Column:
    return F.concat(noisy(c), F.lit(CITATION))


CITED = f"({NOISY} || '{CITATION}')"


def headed(c: Column) -> Column:
    head = "© 2023 X\n\n"
    return F.concat(F.lit(head), c, F.lit("\n\n" + head + "12\n\n" + head), c)


HEADED = "('© 2023 X' || chr(10) || chr(10) || text || chr(10) || chr(10) || '© 2023 X' || chr(10) || chr(10) || '12' || chr(10) || chr(10) || '© 2023 X' || chr(10) || chr(10) || text)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, marked_text: the whole text as goal, source as method around lang, lang as result, the text again as summary.

    Some methods have no confidence, and some goals one that the contract forbids.
    """
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    goal = F.when(k % 4 == 0, "0.95").when(k % 4 == 1, "0.50").when(k % 4 == 2, "0.99").otherwise("0.40")
    method = F.when(k % 5 == 0, "").otherwise(' confidence="0.80"')
    text = F.concat(
        F.lit('<goal confidence="'), goal, F.lit('">'), F.col("text"), F.lit("</goal> <method"), method, F.lit(">"), F.col("source"), F.lit(" <method confidence='0.7'>"), F.col("lang"),
        F.lit("</method></method> <result confidence=\"0.605\">"), F.col("lang"), F.lit("</result><summary> "), F.col("text"), F.lit("\n</summary><summary>second</summary>"),
    )
    return d.select("doc_id", "text", text.alias("marked_text"))


GOAL = "CASE doc_id % 4 WHEN 0 THEN '0.95' WHEN 1 THEN '0.50' WHEN 2 THEN '0.99' ELSE '0.40' END"
MARKED = f"""(SELECT doc_id, text, source, lang, {GOAL} AS goal, CASE WHEN doc_id % 5 = 0 THEN '0.00' ELSE '0.80' END AS method,
 '<goal confidence="' || {GOAL} || '">' || text || '</goal> <method' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' confidence="0.80"' END || '>' || source || ' <method confidence=''0.7''>' || lang
 || '</method></method> <result confidence="0.605">' || lang || '</result><summary> ' || text || chr(10) || '</summary><summary>second</summary>' AS marked_text FROM documents)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element of each document, with faults of every kind."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("element_id"), F.col("source").alias("paper_id"), F.col("lang").alias("section_id"),
        F.when(k % 3 == 0, "goal").when(k % 3 == 1, "method").otherwise(F.when(k % 7 == 0, "claim").otherwise("result")).alias("element_type"),
        F.when(k % 5 == 0, "quantitative").when(k % 5 == 1, "qualitative").when(k % 5 == 2, "theoretical").when(k % 5 == 3, "mixed").otherwise(F.when(k % 11 == 0, "guess").otherwise("unknown")).alias("evidence_type"),
        F.when(k % 17 != 0, ((k % 105) / 100.0).cast("double")).alias("confidence"), F.when(k % 13 == 0, "short").when(k % 13 == 1, " \n ").otherwise(F.col("text")).alias("text"),
        F.when(k % 9 > 0, k % 8).alias("page_number"),
    )


ELEMENTS = """(SELECT doc_id AS element_id, source AS paper_id, lang AS section_id,
 CASE WHEN doc_id % 3 = 0 THEN 'goal' WHEN doc_id % 3 = 1 THEN 'method' WHEN doc_id % 7 = 0 THEN 'claim' ELSE 'result' END AS element_type,
 CASE WHEN doc_id % 5 = 0 THEN 'quantitative' WHEN doc_id % 5 = 1 THEN 'qualitative' WHEN doc_id % 5 = 2 THEN 'theoretical' WHEN doc_id % 5 = 3 THEN 'mixed'
  WHEN doc_id % 11 = 0 THEN 'guess' ELSE 'unknown' END AS evidence_type,
 CASE WHEN doc_id % 17 <> 0 THEN CAST((doc_id % 105) / 100.0 AS DOUBLE) END AS confidence,
 CASE WHEN doc_id % 13 = 0 THEN 'short' WHEN doc_id % 13 = 1 THEN ' ' || chr(10) || ' ' ELSE text END AS text, CASE WHEN doc_id % 9 > 0 THEN doc_id % 8 END AS page_number FROM documents)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.when(u % 2 == 0, "alpha").otherwise("beta").alias("provider"),
        F.when(u % 4 == 0, "gemini-1.5-flash").when(u % 4 == 1, "gpt-4").when(u % 4 == 2, "claude-3").otherwise("other").alias("model"),
        k.alias("tokens"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.when(k % 3 == 0, "timeout").when(k % 3 == 1, "quota").otherwise("")).alias("error_type"),
    )


USAGE = """(SELECT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider,
 CASE user_id % 4 WHEN 0 THEN 'gemini-1.5-flash' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'claude-3' ELSE 'other' END AS model,
 CAST(props->>'$.k' AS BIGINT) AS tokens, value AS seconds, event_type <> 'error' AS success,
 CASE WHEN event_type = 'error' THEN CASE CAST(props->>'$.k' AS BIGINT) % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'quota' ELSE '' END END AS error_type FROM events)"""

# The domain event that stands behind each type in the events table.
DOMAIN = {"signup": "PaperProcessingStarted", "view": "SectionDetected", "click": "SectionProcessingCompleted", "purchase": "PaperProcessingCompleted", "error": "ExtractionFailed"}


def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    named = F.create_map(*[F.lit(x) for pair in DOMAIN.items() for x in pair])
    return e.select(F.col("user_id").cast("string").alias("session"), "event_id", "ts", F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("ProgressUpdate")).alias("event_type"), F.col("value").alias("duration"))


DOMAIN_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DOMAIN.items()) + " ELSE 'ProgressUpdate' END"
DOMAIN_EVENTS = f"(SELECT CAST(user_id AS VARCHAR) AS session, event_id, ts, {DOMAIN_SQL} AS event_type, value AS duration FROM events)"

MESSAGES = (
    "Request timeout after 30s", "Connection refused by host", "Access denied to bucket", "Out of memory", "File was not found: no such file", "Quota exceeded for project", "Invalid JSON in answer",
    "Something else", "Socket read error", "Disk is full", "Too many open files", "User unauthorized", "Service is unavailable", "File is locked by another", "JSON decode error", "Unexpected token at 3",
    "Rate limit reached", "Invalid API key given", "Answer blocked by safety filter", "DNS lookup failed", "Directory was not found",
)
KINDS = (
    "RateLimitError", "LLMValidationError", "PasswordProtectedError", "DataError", "GeminiAuthenticationError", "CorruptedFileError", "ContentFilterError", "ConfigurationError", "PdfError",
    "InvalidTextError", "Unheard", "NoTextLayerError", "ExtractionQualityError",
)


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, kind, message."""
    e = spread(table(spark, sf_dir, "events"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)
    return e.select("event_id", pick(KINDS, F.col("user_id")).alias("kind"), pick(MESSAGES, F.col("event_id")).alias("message"), (F.col("event_id") % 7).alias("attempt"))


FAILURES = (
    "(SELECT event_id, [" + ", ".join(f"'{k}'" for k in KINDS) + f"][CAST(user_id % {len(KINDS)} AS INTEGER) + 1] AS kind, ["
    + ", ".join(f"'{m}'" for m in MESSAGES) + f"][CAST(event_id % {len(MESSAGES)} AS INTEGER) + 1] AS message, event_id % 7 AS attempt FROM events)"
)


def paper_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", (F.col("turn") + 1).cast("int").alias("page_number"), "text", F.length("text").alias("char_count"))


PAGES = "(SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page_number, text, length(text) AS char_count FROM conversations)"
