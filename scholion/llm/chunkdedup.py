"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; the upper bits of 16 depend on the last 16 bytes alone.
A chunk may end only where a word begins, and ends there if the hash says so, not before
``MIN_BYTES``; where ``MAX_BYTES`` pass without such a place, it ends where the hash is least among
the word starts there, or, if there is none, among the character starts. So boundaries follow the
content: an insertion shifts those nearby only, and equal passages get equal chunks.

Chunks are compared by 64-bit digest. The document with the least id owns a digest, where it has it first;
elsewhere, and where it comes again in the same text, the chunk is a repeat. A run of neighbouring repeats of
``MIN_ANCHOR_BYTES`` at least is an anchor: on both sides it is extended, byte by byte, as far as its text goes on
like the owner's, to the last whole word in common. From a common boundary on, chunks are the same to the end
of the passage, so ``REACH`` bytes are enough. What has ``MIN_RUN_BYTES`` then is cut out, so a chance
repeat of a few words stays. A single chunk must also go on alike for ``MIN_CONTEXT_BYTES``, so one
collision of digests removes nothing.

The chunks (digest, text, where it begins and ends) are written once. The least ids of digests are found
with partial sums before the shuffle, and joined with repeated ones only. Runs are made of a text's own
repeats, then ask for the owners' bytes at their ends: each place is asked for once, however many
texts repeat it, and answered by a join with the texts of the owners. All that is joined is a table by then, so
that Spark can split what very many texts share. What a text gets back is bounded by its own number of chunks.

Defined cases: null or empty texts have no chunks and come back as they are; rows without an id come
back as they are and own nothing; rows with the same id are one document, which does not repeat itself, and get
results of their own texts; very long texts are rows like others (a text and its chunks are held at once);
an empty table gives an empty result; other columns pass through (``deduplicate``) or are not read (``spans``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, small_batches

MIN_BYTES = 16
MAX_BYTES = 192
MIN_RUN_BYTES = 80
#: Of a run of chunks, before it is extended.
MIN_ANCHOR_BYTES = 24
MIN_CONTEXT_BYTES = 8
#: Bytes of an owner's text beyond a run: more than a chunk on the right, several on the left, where boundaries may differ at first.
REACH = 512
#: A chunk ends at a word's start with this chance in 16.
ENDS_IN_16 = 4

GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + GEAR[raw[i]] modulo 2**16, by doubling the window four times."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def boundaries(text: bytes) -> list[int]:
    """Where chunks begin and end: 0, ..., len(text)."""
    n = len(text)
    if not n:
        return [0]
    raw = np.frombuffer(text, np.uint8)
    h = gear_hash(raw)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # of words but the first
    cuts = starts[(h[starts - 1] >> np.uint16(12)) < ENDS_IN_16].tolist()
    cuts.append(n)
    out, last = [0], 0
    for c in cuts:
        while c - last > MAX_BYTES:
            last = least(raw, h, starts, last)
            out.append(last)
        if c - last >= MIN_BYTES:
            out.append(c)
            last = c
    if out[-1] != n:
        out.append(n)
    return out


def least(raw: np.ndarray, h: np.ndarray, starts: np.ndarray, last: int) -> int:
    lo, hi = last + MIN_BYTES, last + MAX_BYTES
    places = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi, side="right")]
    if not len(places):
        places = np.arange(lo, hi + 1)
        places = places[(raw[places] & 0xC0) != 0x80]
    return int(places[np.argmin(h[places - 1])]) if len(places) else hi


def chunks(text: bytes) -> tuple[list[int], list[int]]:
    """Boundaries, and the signed 64-bit digest of each chunk without the white space around it."""
    b = boundaries(text)
    return b, [(xxhash.xxh3_64_intdigest(text[i:j].strip()) ^ (1 << 63)) - (1 << 63) for i, j in zip(b, b[1:])]


def anchors(found: list[tuple]) -> list[tuple]:
    """Runs of a text's repeats (at, end, then the owner and where it has the chunk: doc, th, from, to): begin, end, chunks, owner at begin, owner at end."""
    runs, last = [], None
    for at, end, *owner in sorted(found):
        if last and last[0] == at:
            continue  # another owner of the same chunk
        if last and last[1] == at:
            runs[-1][1:3], runs[-1][4] = [end, runs[-1][2] + 1], (owner[0], owner[1], owner[3])
        else:
            runs.append([at, end, 1, (owner[0], owner[1], owner[2]), (owner[0], owner[1], owner[3])])
        last = at, end
    return [tuple(r) for r in runs if r[1] - r[0] >= MIN_ANCHOR_BYTES]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def grown(raw: np.ndarray, start: int, end: int, left: bytes, right: bytes, floor: int = 0) -> tuple[int, int]:
    """The run [start, end) with the whole words around it that are also in the owner's ``left`` and ``right``, not before ``floor``."""
    own, other = raw[max(floor, start - REACH) : start][::-1], np.frombuffer(left, np.uint8)[::-1]
    k = _alike(own, other)
    if not (k == len(own) or _SPACE[own[k]]) or not (k == len(other) or _SPACE[other[k]]):
        k = int(np.flatnonzero(_SPACE[own[:k]]).max(initial=0))
    begin = start - k
    own, other = raw[end : end + REACH], np.frombuffer(right, np.uint8)
    k = _alike(own, other)
    if not (k and _SPACE[own[k - 1]]) and (not (k == len(own) or _SPACE[own[k]]) or not (k == len(other) or _SPACE[other[k]])):
        k = int(np.flatnonzero(_SPACE[own[:k]]).max(initial=-1)) + 1
    return begin, end + k


def cuts(text: bytes, runs: list[tuple]) -> tuple[list[tuple[int, int]], int]:
    """Byte spans to cut and the number of chunks in them. ``runs``: begin, end, chunks, left, right, floor."""
    raw, spans, many = np.frombuffer(text, np.uint8), [], 0
    for start, end, chunks_in, left, right, floor in sorted(runs, key=lambda r: r[:2]):
        a, z = grown(raw, start, end, left or b"", right or b"", floor)
        if z - a >= MIN_RUN_BYTES and (chunks_in > 1 or z - a - (end - start) >= MIN_CONTEXT_BYTES):
            many += chunks_in
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
            else:
                spans.append((a, z))
    return spans, many


def without(text: bytes, spans: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for a, z in spans:
        out.append(text[last:a])
        last = z
    return b"".join([*out, text[last:]]).decode("utf-8", errors="ignore")


def chunk_table(rows: DataFrame) -> DataFrame:
    """A row for each chunk of ``rows`` (doc_id, th, text): digest, doc_id, th, at, end, and where the text has had it before (own_at, own_end)."""

    def emit(batches):
        for batch in batches:
            parts = []
            for doc, th, t in batch.itertuples(index=False, name=None):
                b, digests = chunks(t.encode("utf-8"))
                first: dict[int, int] = {}
                before = [first.setdefault(d, k) for k, d in enumerate(digests)]
                again = [k < n for n, k in enumerate(before)]
                parts.append(pd.DataFrame({
                    "digest": digests, "doc_id": doc, "th": th, "at": b[:-1], "end": b[1:],
                    "own_at": [b[k] if a else -1 for a, k in zip(again, before)], "own_end": [b[k + 1] if a else -1 for a, k in zip(again, before)],
                }))
            if parts:
                yield pd.concat(parts)

    return rows.mapInPandas(emit, "digest long, doc_id long, th long, at int, end int, own_at int, own_end int")


def repeated(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, at, end, o_doc, o_th, o_at, o_end): the repeats of each text, and an owner of each."""
    first = kept.filter("own_at < 0")
    owners = first.groupBy("digest").agg(F.min("doc_id").alias("o_doc"), F.max("doc_id").alias("other")).filter("o_doc <> other").select("digest", "o_doc")
    hits = scratch.keep("hits", kept.join(scratch.keep("owners", owners), "digest"))
    places = hits.filter("doc_id = o_doc AND own_at < 0").groupBy("digest").agg(F.min(F.struct("th", "at", "end")).alias("x"))
    places = scratch.keep("places", places.select("digest", F.col("x.th").alias("o_th"), F.col("x.at").alias("o_at"), F.col("x.end").alias("o_end")))
    foreign = hits.filter("doc_id <> o_doc").join(places, "digest").select("doc_id", "th", "at", "end", "o_doc", "o_th", "o_at", "o_end")
    inner = kept.filter("own_at >= 0").select("doc_id", "th", "at", "end", F.col("doc_id").alias("o_doc"), F.col("th").alias("o_th"), F.col("own_at").alias("o_at"), F.col("own_end").alias("o_end"))
    return foreign.union(inner)


def runs_of(repeats: DataFrame) -> DataFrame:
    """A row for each anchor: doc_id, th, begin, end, chunks, and the owners and places where it begins (l_) and ends (r_)."""
    own = repeats.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "end", "o_doc", "o_th", "o_at", "o_end")).alias("xs"))
    names = ["doc_id", "th", "begin", "end", "chunks", "l_doc", "l_th", "l_at", "r_doc", "r_th", "r_at"]

    def run(batches):
        for batch in batches:
            out = []
            for doc, th, xs in batch.itertuples(index=False, name=None):
                out += [(doc, th, *r[:3], *r[3], *r[4]) for r in anchors([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in xs])]
            yield pd.DataFrame(out, columns=names)

    return own.mapInPandas(run, "doc_id long, th long, begin int, end int, chunks int, l_doc long, l_th long, l_at int, r_doc long, r_th long, r_at int")


def contexts(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(o_doc, o_th, o_at, before, bytes): what the owners' texts have at the places that runs ask for, each once."""
    asked = [runs.select(F.col(f"{k}_doc").alias("o_doc"), F.col(f"{k}_th").alias("o_th"), F.col(f"{k}_at").alias("o_at"), F.lit(k == "l").alias("before")) for k in "lr"]
    wanted = asked[0].union(asked[1]).distinct().groupBy("o_doc", "o_th").agg(F.collect_list(F.struct("o_at", "before")).alias("places"))
    texts = rows.select(F.col("doc_id").alias("o_doc"), F.col("th").alias("o_th"), "text").join(wanted, ["o_doc", "o_th"])

    def run(batches):
        for batch in batches:
            out = []
            for doc, th, text, places in batch.itertuples(index=False, name=None):
                raw = text.encode("utf-8")
                for x in places:
                    at = x["o_at"]
                    out.append((doc, th, at, x["before"], raw[max(0, at - REACH) : at] if x["before"] else raw[at : at + REACH]))
            yield pd.DataFrame(out, columns=["o_doc", "o_th", "o_at", "before", "bytes"])

    found = texts.mapInPandas(run, "o_doc long, o_th long, o_at int, before boolean, bytes binary")
    return found.dropDuplicates(["o_doc", "o_th", "o_at", "before"])


def edges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, runs): the anchors of each text with what their owners have around them; texts without any have no row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text <> ''")
    scratch = Scratch(spark, "chunks")
    kept = scratch.keep("digests", chunk_table(rows))
    runs = scratch.keep("runs", runs_of(repeated(kept, scratch)))
    scratch.drop("digests", "owners", "hits", "places")
    around = scratch.keep("around", contexts(rows, runs))
    for k, name in (("l", "left"), ("r", "right")):
        side = around.filter("before" if k == "l" else "NOT before").select(F.col("o_doc").alias(f"{k}_doc"), F.col("o_th").alias(f"{k}_th"), F.col("o_at").alias(f"{k}_at"), F.col("bytes").alias(name))
        runs = runs.join(side, [f"{k}_doc", f"{k}_th", f"{k}_at"], "left")
    # a text's earlier part owns what comes again: the repeat doesn't grow into it
    same = (F.col("doc_id") == F.col("r_doc")) & (F.col("th") == F.col("r_th")) & (F.col("r_at") <= F.col("begin"))
    withed = runs.select("doc_id", "th", F.struct("begin", "end", "chunks", "left", "right", F.when(same, F.col("r_at")).otherwise(0).alias("floor")).alias("x"))
    out = scratch.keep("edges", withed.groupBy("doc_id", "th").agg(F.collect_list("x").alias("runs")))
    scratch.drop("runs", "around")
    return out


def _cut(raw: bytes, runs) -> tuple[list[tuple[int, int]], int]:
    return cuts(raw, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in runs]) if runs is not None else ([], 0)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, text without repeats, number of chunks, number of repeated ones cut out, the byte spans cut out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    joined = rows.join(edges(docs, id_col, text_col), ["doc_id", "th"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, text string, n_chunks int, n_repeats int, cut_bytes long, cut_spans array<struct<start:int,end:int>>"

    def run(batches):
        for batch in batches:
            out = []
            for i, t, runs in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                raw = t.encode("utf-8") if isinstance(t, str) else b""
                cut, many = _cut(raw, runs)
                out.append((i, without(raw, cut) if cut else t, len(boundaries(raw)) - 1, many, sum(z - a for a, z in cut), [{"start": a, "end": z} for a, z in cut]))
            frame = pd.DataFrame(out, columns=["doc_id", "text", "n_chunks", "n_repeats", "cut_bytes", "cut_spans"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return joined.mapInPandas(run, schema)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats cut out of the text; every row stays, other columns pass through."""
    key, digest, many = "__chunk_doc", "__chunk_text", "__chunk_runs"
    found = edges(docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("th").alias(digest), F.col("runs").alias(many))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, runs, strict=True):
            raw = t.encode("utf-8") if isinstance(t, str) else b""
            cut = _cut(raw, own)[0]
            out.append(without(raw, cut) if cut else t)
        return pd.Series(out)

    joined = docs.join(found, (docs[id_col].cast("long") == F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(digest)), "left")
    text = F.when(F.col(many).isNull(), F.col(text_col)).otherwise(cleaned(F.col(text_col), F.col(many)))
    return joined.withColumn(text_col, text).select(*docs.columns)
