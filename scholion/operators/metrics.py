"""Usage, extraction and event metrics. Each is one hash aggregate with partial sums; empty input gives zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price of a thousand tokens.
RATES = {"gemini-1.5-flash": 0.000075, "gpt-4": 0.03, "claude-3": 0.025}
DEFAULT_RATE = 0.01
#: Events whose duration counts.
COMPLETIONS = ("ExtractionCompleted", "SectionProcessingCompleted", "ChunkProcessingCompleted", "PaperProcessingCompleted", "BatchProcessingCompleted")


def rate(model: Column) -> Column:
    """Price of a thousand tokens; the rate table is a literal, so there is nothing to join."""
    known = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, model), F.lit(DEFAULT_RATE))


def usage_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Over (provider, model, tokens, seconds, success)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        F.count_if("success").alias("successful"),
        (F.count("*") - F.count_if("success")).alias("failed"),
        zero(F.sum("tokens")).alias("total_tokens"),
        F.coalesce(F.sum(F.col("tokens") / 1000 * rate(F.col("model"))), F.lit(0.0)).alias("cost"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
    )


def by_provider(df: DataFrame) -> DataFrame:
    return df.groupBy("provider").agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def errors_by_type(df: DataFrame, *keys: str) -> DataFrame:
    """Null and empty types don't count."""
    return df.filter(F.col("error_type") != "").groupBy(*keys, "error_type").agg(F.count("*").alias("n"))


def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A small count table as one map; the number of keys is that of error types or providers."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return df.agg(F.map_from_entries(entries).alias(name))


def extraction_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Over (success, pages, elements, characters, seconds)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_extractions"),
        F.count_if("success").alias("successful"),
        (F.count("*") - F.count_if("success")).alias("failed"),
        total("pages").alias("total_pages"),
        total("elements").alias("total_elements"),
        total("characters").alias("total_characters"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
    )


def event_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count("*").alias("n"))


def event_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Total, and the mean duration of completion events (0.0 if there is none)."""
    done = F.when(F.col("event_type").isin(*COMPLETIONS), F.col("duration"))
    return df.groupBy(*keys).agg(F.count("*").alias("total_events"), F.coalesce(F.avg(done), F.lit(0.0)).alias("avg_duration"))


def output_tokens(texts: Column) -> Column:
    """Tokens of an array of answers: a quarter of their lengths in all, rounded down; null answers count as empty."""
    return F.floor(F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.length(t), F.lit(0))) / 4)
