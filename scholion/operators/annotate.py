"""Annotation: prompts, the annotator protocol, a rule annotator, and the distributed call with retry.

An annotator turns a text into marked text. Real ones call a model; the one here marks sentences by
cue phrases with fixed confidences, so that results repeat. It is no substitute for a model in quality.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunking, markup
from ..functions.batches import small_batches
from ..functions.text import strip, token_estimate


class Annotator(Protocol):
    """One per partition; ``annotate`` may raise."""

    def annotate(self, text: str) -> str: ...


@dataclass(frozen=True)
class Prompts:
    """Parts of a prompt. ``rules`` are joined by line feeds, or numbered if ``numbered``."""

    system: str = "You read research papers. Clean up the text of one and mark what matters in it."
    cleaning: str = "First, remove page numbers, headers, footers, broken hyphenation and notices. Keep all content and references."
    marking: str = 'Then mark goals, methods and results: <goal confidence="0.XX">, <method confidence="0.XX">, <result confidence="0.XX">. Mark only what you are sure of.'
    summary: str = "Last, summarise the paper in two or three plain sentences inside <summary></summary>."
    rules: tuple[str, ...] = ("Return the whole text.", "Confidences are from 0.50 to 0.99.", "Write < and > of the text as &lt; and &gt;.")
    chunk_context: str = "This may be one part of a longer paper."
    numbered: bool = False
    template: str = "{system}\n\n{cleaning}\n\n{marking}\n\n{summary}\n\nRules:\n{rules}\n\nPaper text:\n{text}\n"

    def frame(self) -> tuple[str, str]:
        """What stands before and after the text."""
        rules = [f"{k + 1}. {r}" for k, r in enumerate(self.rules)] if self.numbered else self.rules
        filled = self.template.format(system=self.system.strip(), cleaning=self.cleaning.strip(), marking=self.marking.strip(), summary=self.summary.strip(), rules="\n".join(rules), text="\0")
        before, _, after = filled.partition("\0")
        return before, after


def prompt(text: Column, total_chunks: Column, prompts: Prompts | None = None) -> Column:
    """The prompt of each chunk: plain concatenation with literals."""
    prompts = prompts or Prompts()
    before, after = prompts.frame()
    return F.concat(F.lit(before), text, F.lit(after), F.when(total_chunks > 1, F.lit("\n\n" + prompts.chunk_context)).otherwise(""))


def call_error(message: Column) -> Column:
    """Kind of error that a provider's message stands for."""
    low = F.lower(message)
    return (
        F.when(low.contains("quota") | low.contains("rate limit"), "RateLimitError")
        .when(low.contains("invalid api key") | low.contains("authentication"), "GeminiAuthenticationError")
        .when(low.contains("blocked") | low.contains("safety"), "GeminiSafetyFilterError")
        .when(message.isNotNull(), "GeminiApiError")
    )


@dataclass(frozen=True)
class RuleAnnotator:
    """Marks a sentence by the first category one of whose cues it contains; a summary of its first sentences."""

    cues: tuple[tuple[str, float, str], ...] = (
        ("goal", 0.85, r"\b(?:aim|goal|objective|we ask|research question|purpose)s?\b"),
        ("method", 0.80, r"\b(?:method|approach|we use|procedure|experiment|participants)s?\b"),
        ("result", 0.90, r"\b(?:result|finding|we found|showed|significant|conclude)s?\b"),
    )
    extra: tuple[tuple[str, float, str], ...] = ()
    summary_sentences: int = 2

    @cached_property
    def compiled(self) -> list[tuple[str, float, re.Pattern]]:
        return [(k, c, re.compile(p, re.IGNORECASE)) for k, c, p in (*self.cues, *self.extra)]

    def annotate(self, text: str) -> str:
        found, out, kept = self.compiled, [], []
        for part in re.split(r"((?<=[.!?])\s+(?=[^\W\d_]))", text):
            escaped = part.replace("<", "&lt;").replace(">", "&gt;")
            hit = next((x for x in found if part.strip() and x[2].search(part)), None)
            out.append(f'<{hit[0]} confidence="{hit[1]:.2f}">{escaped}</{hit[0]}>' if hit else escaped)
            if part.strip() and len(kept) < self.summary_sentences:
                kept.append(escaped.strip())
        return f"{''.join(out)}<summary>{' '.join(kept)}</summary>" if text.strip() else ""


#: Annotators by name. Those that need a network are the user's to register.
REGISTRY: dict[str, Callable[..., Annotator]] = {"rules": RuleAnnotator}


def annotator(name: str, **options) -> Callable[[], Annotator]:
    """A factory for the annotator of that name."""
    if name not in REGISTRY:
        raise ValueError(f"no annotator {name!r}; registered: {sorted(REGISTRY)}")
    return lambda: REGISTRY[name](**options)


@dataclass(frozen=True)
class RetryPolicy:
    """``never``: exceptions that are not tried again; ``on``: those that are; ``timeout``: seconds an attempt may take.

    An attempt that takes longer counts as failed; Python cannot end its thread, which is left behind.
    """

    attempts: int = 3
    strategy: str = "exponential_backoff"
    initial: float = 2.0
    multiplier: float = 2.0
    maximum: float = 30.0
    timeout: float | None = None
    on: tuple[type[BaseException], ...] = (Exception,)
    never: tuple[type[BaseException], ...] = (ValueError,)
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def delay(self, attempt: int, error: BaseException | None = None) -> float:
        given = getattr(error, "retry_after", None)
        plain = {"exponential_backoff": self.initial * self.multiplier**attempt, "linear_backoff": self.initial * (attempt + 1), "fixed_delay": self.initial}.get(self.strategy, 0.0)
        return min(given or plain, self.maximum)

    def attempt(self, call: Callable[[], str]) -> str:
        if not self.timeout:
            return call()
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call).result(self.timeout)
        finally:
            pool.shutdown(wait=False)

    def run(self, call: Callable[[], str]) -> tuple[str | None, int, str | None]:
        """(result, attempts made, error): result is null if all failed."""
        for attempt in range(self.attempts):
            try:
                return self.attempt(call), attempt + 1, None
            except self.never as e:
                return None, attempt + 1, f"{type(e).__name__}: {e}"
            except self.on as e:
                if attempt + 1 == self.attempts:
                    return None, attempt + 1, f"{type(e).__name__}: {e}"
                self.sleep(self.delay(attempt, e))
        return None, 0, None


def annotate_chunks(chunks: DataFrame, make: Callable[[], Annotator], policy: RetryPolicy | None = None, pause: float = 0.0) -> DataFrame:
    """Annotate ``chunk`` of each row; adds marked, attempts, error. A chunk that fails stays unmarked.

    One annotator per partition; ``repartition`` before bounds how many call at once. The pause is
    between calls of a partition.
    """
    policy = policy or RetryPolicy()
    schema = T.StructType([*chunks.schema.fields, T.StructField("marked", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, first = None, True
        for batch in batches:
            rows = []
            for text in batch["chunk"]:
                if not (isinstance(text, str) and text.strip()):
                    rows.append(("", 0, None))
                    continue
                client = client or make()
                if pause and not first:
                    time.sleep(pause)
                first = False
                got, tries, error = policy.run(lambda t=text, c=client: c.annotate(t).strip())
                rows.append((text if got is None else got, tries, error))
            yield batch.assign(**{n: [r[i] for r in rows] for i, n in enumerate(("marked", "attempts", "error"))})

    small_batches(chunks.sparkSession)
    return chunks.mapInPandas(run, schema)


def annotate(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Annotator] = RuleAnnotator, policy: RetryPolicy | None = None, single: int = chunking.SINGLE_LIMIT, limit: int = chunking.CHUNK_LIMIT, overlap: int = chunking.OVERLAP, pause: float = 0.0, with_elements: bool = False) -> DataFrame:
    """One row per document: the id, n_chunks, failed_chunks, marked_text (marked chunks joined by a blank line).

    ``with_elements``: also ``elements`` of the marked text without its summaries, so it need not go to Python again.
    A chunk that fails stays unmarked, a document of one chunk too; ``calls`` keeps each call's attempts and faults, and
    tells of such a document by an error.

    Texts of up to ``single`` characters are one call. A document's chunks are called in turn where the
    document lies, so nothing is shuffled; ``annotate_chunks`` and ``merge_chunks`` spread them instead.
    """
    policy = policy or RetryPolicy()
    key = docs.schema[id_col]
    schema = T.StructType([key, T.StructField("n_chunks", T.LongType()), T.StructField("failed_chunks", T.LongType()), T.StructField("marked_text", T.StringType())])
    if with_elements:
        schema = T.StructType([*schema.fields, *T.StructType.fromDDL(f"elements {markup.ELEMENTS}").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            rows = []
            for text in batch[text_col]:
                if not (isinstance(text, str) and text.strip()):
                    rows.append((1, 0, ""))
                    continue
                client = client or make()
                parts = [text] if len(text) <= single else chunking.overlapped(chunking.chunk_text(text, limit - overlap), overlap)
                marked, failed = [], 0
                for k, part in enumerate(parts):
                    if pause and k:
                        time.sleep(pause)
                    got, _, _ = policy.run(lambda t=part, c=client: c.annotate(t).strip())
                    failed += got is None
                    marked.append(part if got is None else got)
                rows.append((len(parts), failed, "\n\n".join(marked)))
            out = pd.DataFrame(rows, columns=["n_chunks", "failed_chunks", "marked_text"], index=batch.index)
            out.insert(0, id_col, batch[id_col])
            yield out.assign(elements=out["marked_text"].map(lambda t: markup.element_rows(markup.SUMMARY.sub("", t)))) if with_elements else out

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInPandas(run, schema)


def respond(annotated: DataFrame, id_col: str, seconds: Column | None = None) -> DataFrame:
    """The answer for each document: id, title, authors, text with markup, summary, seconds."""
    return annotated.select(
        F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 8).alias("paper_id"), F.col(id_col),
        F.lit("Extracted Paper").alias("title"), F.array().cast("array<string>").alias("authors"),
        markup.without_summaries(F.col("marked_text")).alias("text_with_markup"), markup.summary(F.col("marked_text")).alias("summary"),
        (F.lit(0.0) if seconds is None else seconds).alias("seconds"),
    )


def analyze_section(section_text: Column, marked: Column, blank: Column | None = None) -> Column:
    """struct(elements, input_tokens, output_tokens) of a section; a blank one has no elements.

    ``blank`` tells which sections are; without it, those of white space alone.
    """
    none = F.array().cast("array<struct<element_type:string,confidence:string,text:string>>")
    found = F.when(strip(section_text) == "" if blank is None else blank, none).otherwise(markup.elements(marked))
    out = F.aggregate(found, F.lit(0).cast("long"), lambda a, e: a + F.length(F.to_json(e)))
    return F.struct(found.alias("elements"), token_estimate(section_text).alias("input_tokens"), F.floor(out / 4).alias("output_tokens"))


def paper_summary(abstract: Column, introduction: Column, made: Column) -> Column:
    """struct(summary, confidence, source_sections); empty, with confidence 0, if both inputs are blank."""
    a, b = (strip(F.coalesce(c, F.lit(""))) != "" for c in (abstract, introduction))
    used = F.array_compact(F.array(F.when(a, F.lit("abstract")), F.when(b, F.lit("introduction"))))
    return F.struct(F.when(a | b, made).otherwise("").alias("summary"), F.when(a | b, 0.8).otherwise(0.0).alias("confidence"), used.alias("source_sections"))


def usage_stats(calls: DataFrame) -> DataFrame:
    """One row: calls, answered, attempts. An answer counts if it is not empty."""
    return calls.agg(F.count("*").alias("calls"), F.count_if(F.coalesce(F.length("marked"), F.lit(0)) > 0).alias("answered"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
