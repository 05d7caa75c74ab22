"""Chunks of bounded size, overlap between neighbours, and merging.

Greedy packing depends on order, so it is a fold over a text's own pieces: an Arrow UDF by default,
``native_word_chunks`` is the same fold in Catalyst for words, kept as a cross-check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches
from .text import ABBREVIATIONS

# Sizes in characters.
SINGLE_LIMIT, CHUNK_LIMIT, OVERLAP = 15000, 12000, 300
DEFAULT_LIMIT, DEFAULT_OVERLAP = 8000, 200
STRATEGIES = ("sentence", "word")


def greedy(pieces: list[str], limit: int, glue: str, smaller: Callable[[str], list[str]] | None = None) -> list[str]:
    """Pack pieces in order into chunks of up to ``limit``; one that is too long goes to ``smaller``, or stands alone."""
    chunks, open_chunk = [], ""
    for p in pieces:
        if smaller and len(p) > limit:
            chunks += [open_chunk] * bool(open_chunk) + smaller(p)
            open_chunk = ""
        elif open_chunk and len(open_chunk) + len(p) + len(glue) > limit:
            chunks.append(open_chunk)
            open_chunk = p
        else:
            open_chunk = open_chunk + glue + p if open_chunk else p
    return chunks + [open_chunk] * bool(open_chunk)


def split_sentences(text: str) -> list[str]:
    for word in ABBREVIATIONS:
        text = text.replace(word, word.replace(".", "·"))
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)
    return [s for s in (p.replace("·", ".").strip() for p in parts) if s]


def by_words(text: str, limit: int) -> list[str]:
    return greedy(text.split(), limit, " ")


def by_sentences(text: str, limit: int) -> list[str]:
    return greedy(split_sentences(text), limit, " ", lambda s: by_words(s, limit))


def chunk_text(text: str, limit: int, strategy: str = "sentence") -> list[str]:
    """Chunks of a text; one that fits is returned as it is."""
    if len(text) <= limit:
        return [text]
    if strategy == "word":
        return by_words(text, limit)
    paragraphs = [p for p in map(str.strip, re.split(r"\n\s*\n", text)) if p]
    return greedy(paragraphs, limit, "\n\n", lambda p: by_sentences(p, limit))


def chunks(c: Column, limit: int, strategy: str = "sentence") -> Column:
    """array<string> of chunks; null for null."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunk_text(t, limit, strategy))

    return run(c)


def native_word_chunks(c: Column, limit: int) -> Column:
    """``by_words`` as a Catalyst fold."""
    words = F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(s: Column, w: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + F.length(w) + 1 > limit)
        joined = F.when(s["cur"] == "", w).otherwise(F.concat(s["cur"], F.lit(" "), w))
        return F.struct(F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"), F.when(full, w).otherwise(joined).alias("cur"))

    packed = F.aggregate(words, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(packed)


def with_overlap(chunk_array: Column, overlap: int) -> Column:
    """Prefix each chunk but the first with the end of the one before, if that is longer than ``overlap``.

    The end is cut after its first sentence boundary.
    """

    def one(x: Column, i: Column) -> Column:
        before = F.get(chunk_array, i - 1)
        tail = F.substring(before, -overlap, overlap)
        cut = F.regexp_replace(tail, r"(?Us)^.*?[.!?]\s+", "")
        return F.when((i > 0) & (F.length(before) > overlap), F.concat(cut, F.lit(" "), x)).otherwise(x)

    return F.transform(chunk_array, one)


def prepared_chunks(c: Column, limit: int = CHUNK_LIMIT, overlap: int = OVERLAP, strategy: str = "sentence") -> Column:
    """Chunks with overlap; a text that fits is one chunk. One pass in one Arrow UDF."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")

    def prepare(t: str | None) -> list[str] | None:
        return None if t is None else [t] if len(t) <= limit else overlapped(chunk_text(t, limit - overlap, strategy), overlap)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(prepare)

    return run(c)


def overlapped(parts: list[str], overlap: int) -> list[str]:
    """``with_overlap`` for a list."""
    out = parts[:1]
    for before, x in zip(parts, parts[1:]):
        if len(before) > overlap:
            tail = before[-overlap:]
            m = re.search(r"[.!?]\s+", tail)
            x = f"{tail[m.end():] if m else tail} {x}"
        out.append(x)
    return out


def chunk_rows(df: DataFrame, text_col: str, limit: int = CHUNK_LIMIT, overlap: int = OVERLAP, strategy: str = "sentence", single: int | None = None) -> DataFrame:
    """One row per prepared chunk of ``text_col``: the other columns, chunk_index from 1, total_chunks, chunk. Null texts have none.

    A text of up to ``single`` characters (``limit`` if null) is one chunk. One pass: what explodes an array that a UDF
    makes may run it twice, as Spark tests its size below the generator.
    """
    whole = limit if single is None else single
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(batches):
        for batch in batches:
            parts = [[] if t is None else [t] if len(t) <= whole else overlapped(chunk_text(t, limit - overlap, strategy), overlap) for t in batch[text_col]]
            if any(parts):
                out = batch.drop(columns=[text_col]).loc[batch.index.repeat([len(p) for p in parts])].reset_index(drop=True)
                yield out.assign(chunk_index=[k + 1 for p in parts for k in range(len(p))], total_chunks=[len(p) for p in parts for _ in p], chunk=pd.Series([c for p in parts for c in p], dtype=object))

    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def explode_chunks(df: DataFrame, chunk_col: str = "chunks") -> DataFrame:
    """One row per chunk: the other columns, chunk_index from 1, total_chunks, chunk."""
    rest = [c for c in df.columns if c != chunk_col]
    return df.select(*rest, F.size(chunk_col).alias("total_chunks"), F.posexplode(chunk_col).alias("at", "chunk")).select(*rest, (F.col("at") + 1).alias("chunk_index"), "total_chunks", "chunk")


def merge_chunks(df: DataFrame, keys: list[str], index_col: str, text_col: str, glue: str = "\n\n", name: str = "merged") -> DataFrame:
    """Chunks of each key joined in order. Overlap stays in, as it was sent."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), glue).alias(name))

