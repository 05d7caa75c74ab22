"""Interaction audit of five filters: what each removes in each order of application, by a first-failure lookup.

A document's failures are five bits. ``FIRST`` has, for each of the 32 sets of failures and each of the 120
orders, the step at which the document goes (``STEPS`` if it stays). A task looks up its documents' rows of
that table, counts (order, step) with ``np.bincount`` for each part, once for each label, and emits the
arrays' cells when it ends, or when ``PARTS`` parts have come together; Spark sums the cells. So what is moved
is 600 rows for each part and task, however many documents there are.

A: fewer than ``WORDS`` words. B: fewer than ``DISTINCT`` per cent of the words are different. C: more than
``CAPITALS`` per cent of the code points are A-Z. D: one of ``SIGNS``. E: the text is that of a smaller id,
anywhere in the table. For E, texts are compared by SHA-256; one reading of the texts makes a table of
ids, digests and bits, from which the least ids of repeated digests are found with partial sums and joined
as a table, so Spark can split a text that very many rows share. Labels are joined likewise.

Defined cases: a null text counts as empty, a null part as the empty string; an empty text fails A alone, and
E if a smaller id has one; a row without an id is no copy and makes none, and has no labels; rows of one id are
documents of their own, none a copy of another for that; of several labels of an id one that is 1 counts;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

NAMES = "ABCDE"
STEPS = len(NAMES)
WORDS, DISTINCT, CAPITALS = 100, 80, 10
SIGNS = re.compile(rb"[#$%&*|]")
#: Parts that a task holds counts of at once.
PARTS = 500

ORDERS = ["".join(p) for p in permutations(NAMES)]
#: The filter of each step of each order.
AT = np.array([[NAMES.index(c) for c in order] for order in ORDERS])
_FAILS = (np.arange(1 << STEPS)[:, None, None] >> AT[None]) & 1
FIRST = np.where(_FAILS.any(axis=2), _FAILS.argmax(axis=2), STEPS).astype(np.int64)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
CELLS = len(ORDERS) * STEPS


def failures(raw: bytes) -> int:
    """The bits of A to D."""
    words = raw.split()
    b = np.frombuffer(raw, np.uint8)
    points, capitals = int(np.count_nonzero((b & 0xC0) != 0x80)), int(np.count_nonzero((b >= 65) & (b <= 90)))
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * points) << 2 | (SIGNS.search(raw) is not None) << 3


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, digest, fails): one reading of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fails = [], []
            for text in batch.column(2):
                raw = text.as_py() or b""
                digests.append(hashlib.sha256(raw).digest())
                fails.append(failures(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())], names=["doc_id", "part", "digest", "fails"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def labelled_failures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, scratch: Scratch) -> DataFrame:
    """(part, fails, good, toxic) of every row, E among its failures."""
    small_batches(docs.sparkSession)
    rows = scratch.keep("rows", measured(docs, id_col, text_col, part_col))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("digest", "first")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")])
    copied = rows.join(scratch.keep("first", first), "digest", "left").withColumn("fails", F.when(F.col("doc_id") > F.col("first"), F.col("fails") + 16).otherwise(F.col("fails")))
    known = copied.join(scratch.keep("marks", marks), "doc_id", "left")
    return known.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def counts(fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """(order and step, measure) of some documents of one part."""
    step = FIRST[fails]
    cell = np.arange(len(ORDERS)) * (STEPS + 1) + step
    here = lambda some: np.bincount(cell[some].ravel(), minlength=len(ORDERS) * (STEPS + 1)).reshape(-1, STEPS + 1)[:, :STEPS]
    removed = here(slice(None))
    each = ((fails[:, None] >> np.arange(STEPS)) & 1).sum(axis=0)[AT]
    alone = np.array([(fails == 1 << f).sum() for f in range(STEPS)])[AT]
    by_filter = np.bincount(AT.ravel(), weights=removed.ravel(), minlength=STEPS).astype(np.int64)[AT]
    out = [len(fails) - np.cumsum(removed, axis=1), removed, each - removed, alone, here(good), here(toxic), by_filter]
    return np.stack([x.ravel() for x in out], axis=1)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order and step: part, filter_order, step (from 1), and ``MEASURES``."""
    scratch = Scratch(docs.sparkSession, "audit")

    def cells(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, total in held.items():
            columns = [pa.array([part] * CELLS), pa.array(np.arange(CELLS, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(len(MEASURES)))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "cell", *MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            which, fails, good, toxic = (np.asarray(x) for x in (parts.indices, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)))
            for k, part in enumerate(parts.dictionary.to_pylist()):
                mine = which == k
                held[part] = held.get(part, 0) + counts(fails[mine], good[mine].astype(bool), toxic[mine].astype(bool))
            if len(held) >= PARTS:
                yield from cells(held)
                held = {}
        yield from cells(held)

    known = labelled_failures(docs, labels, id_col, text_col, part_col, scratch)
    sums = known.mapInArrow(run, "part string, cell int, " + ", ".join(f"{m} long" for m in MEASURES)).groupBy("part", "cell").agg(*[F.sum(m).alias(m) for m in MEASURES])
    order = F.element_at(F.lit(ORDERS), (F.floor(F.col("cell") / STEPS) + 1).cast("int"))
    out = scratch.keep("sums", sums.select("part", order.alias("filter_order"), (F.col("cell") % STEPS + 1).alias("step"), *MEASURES))
    scratch.drop("rows", "first", "marks")
    return out


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(words.doc_id > first, false)] AS f
  FROM words JOIN firsts USING (text) LEFT JOIN marks ON words.doc_id = marks.doc_id
), kinds AS (SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT o, l.i AS step, array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order FROM orders, letters l
), told AS (
  SELECT part, filter_order, step, o[step] AS own, n, good, toxic, f[o[step]] AS fails, f, list_bool_or([f[x] FOR x IN o[1:step - 1]]) AS gone
  FROM kinds, steps
), sums AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE NOT fails AND NOT coalesce(gone, false)) AS kept, sum(n) FILTER (WHERE fails AND NOT coalesce(gone, false)) AS removed,
         sum(n) FILTER (WHERE fails AND gone) AS redundant, sum(n) FILTER (WHERE fails AND len([x FOR x IN f IF x]) = 1) AS unique_fails,
         sum(n) FILTER (WHERE fails AND NOT coalesce(gone, false) AND good) AS good_lost, sum(n) FILTER (WHERE fails AND NOT coalesce(gone, false) AND toxic) AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM sums
"""
