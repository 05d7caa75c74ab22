"""Character positions: where each character of a cleaned text came from, and where spans lie on a page."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import FURNITURE, MIN_CONTENT_CHARS, PROTECTED, REPEATED_LINE_CHARS, REPEATED_LINE_COUNT, WEB_PREFIXES

_NOT_CONTENT = re.compile(FURNITURE)
_ROMAN = re.compile("^[ivxlcdm]+$")


def content_line(line: str) -> bool:
    s = line.strip()
    low = s.lower()
    return not (len(s) < MIN_CONTENT_CHARS or s.isdigit() or _ROMAN.match(low) or low.startswith(WEB_PREFIXES) or _NOT_CONTENT.search(low))


Run = tuple[int, int]  # where it begins in the original (-1: inserted), and how long it is


class Tracked:
    """A text and, for each run of its characters, where it was in the original."""

    def __init__(self, text: str, runs: list[Run] | None = None):
        self.text, self.runs = text, [(0, len(text))] if runs is None else runs
        self.starts = list(accumulate((n for _, n in self.runs), initial=0))

    def part(self, a: int, z: int) -> tuple[str, list[Run]]:
        out = []
        for k in range(bisect_right(self.starts, a) - 1, len(self.runs)):
            at, (origin, n) = self.starts[k], self.runs[k]
            if at >= z:
                break
            lo, hi = max(a, at), min(z, at + n)
            if hi > lo:
                out.append((origin if origin < 0 else origin + lo - at, hi - lo))
        return self.text[a:z], out

    def pieces(self, parts: list[tuple[str, list[Run]]]) -> Tracked:
        runs: list[Run] = []
        for origin, n in (r for _, own in parts for r in own):
            if runs and origin >= 0 and runs[-1][0] >= 0 and runs[-1][0] + runs[-1][1] == origin:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((origin, n))
        return Tracked("".join(p[0] for p in parts), runs)

    def dehyphenated(self) -> Tracked:
        parts, last = [], 0
        for m in re.finditer(r"(\w+)-\s*\n\s*(\w+)", self.text):
            parts += [self.part(last, m.end(1)), self.part(m.start(2), m.end(2))]
            last = m.end()
        return self.pieces([*parts, self.part(last, len(self.text))])

    def collapsed(self) -> Tracked:
        parts, last = [], 0
        for m in re.finditer(PROTECTED, self.text):
            parts += [*self.squeezed(last, m.start()), self.part(m.start(), m.end())]
            last = m.end()
        return self.pieces([*parts, *self.squeezed(last, len(self.text))])

    def squeezed(self, a: int, z: int) -> list[tuple[str, list[Run]]]:
        parts, last = [], a
        for m in re.compile(" {2,}|\n+").finditer(self.text, a, z):
            start = self.part(m.start(), m.start() + 1)[1]
            new = " " if m[0][0] == " " or len(m[0]) == 1 else "\n\n"
            parts += [self.part(last, m.start()), (new, start * len(new))]
            last = m.end()
        return [*parts, self.part(last, z)]

    def without_furniture(self) -> Tracked:
        lines, at, counts = [], 0, {}
        for line in self.text.split("\n"):
            lines.append((line, at))
            at += len(line) + 1
            s = line.strip()
            if 0 < len(s) < REPEATED_LINE_CHARS:
                counts[s] = counts.get(s, 0) + 1
        drop = {s for s, n in counts.items() if n >= REPEATED_LINE_COUNT and not content_line(s)}
        if not drop:
            return self
        parts: list[tuple[str, list[Run]]] = []
        some = False
        for line, start in lines:
            if line.strip() not in drop:
                if some:
                    parts.append(("\n", [(-1, 1)]))
                parts.append(self.part(start, start + len(line)))
                some = some or bool(line)
        return self.pieces(parts)


def mapped_runs(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The normalized text, and (cleaned, original, length) of its runs; inserted characters are in none."""
    t = Tracked(text).dehyphenated().collapsed().without_furniture()
    return t.text, [(at, origin, n) for at, (origin, n) in zip(t.starts, t.runs) if origin >= 0 and n]


def mapped(text: str) -> tuple[str, dict[int, int]]:
    """The normalized text and the map from its indices to those of ``text``."""
    clean, runs = mapped_runs(text)
    return clean, {at + k: origin + k for at, origin, n in runs for k in range(n)}


RUNS = "array<struct<cleaned:int,original:int,length:int>>"


def traced(c: Column) -> Column:
    """struct(cleaned, runs): the normalized text and its runs that lie together in the original, in order; null for null.

    The steps are traced in an Arrow UDF: expressions have no positions of matches.
    """

    @F.pandas_udf(f"struct<cleaned:string,runs:{RUNS}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, out = ("cleaned", "original", "length"), []
        for t in texts:
            clean, runs = (None, None) if t is None else mapped_runs(t)
            out.append((clean, None if t is None else [dict(zip(names, r, strict=True)) for r in runs]))
        return pd.DataFrame(out, columns=["cleaned", "runs"])

    return F.when(c.isNotNull(), run(c))


def char_runs(c: Column) -> Column:
    """The runs alone."""
    return traced(c)["runs"]


def original_index(runs: Column, index: Column) -> Column:
    """The original index of a cleaned one, by the run that holds it; -1 if there is none."""
    hit = F.filter(runs, lambda r: (r["cleaned"] <= index) & (index < r["cleaned"] + r["length"]))
    return F.coalesce(F.get(hit, F.lit(0))["original"] + index - F.get(hit, F.lit(0))["cleaned"], F.lit(-1))


def char_mapping(c: Column) -> Column:
    """map<int,int> from each cleaned to its original index, for those who want one; ``char_runs`` says the same in less."""
    pairs = lambda r: F.transform(F.sequence(F.lit(0), r["length"] - 1), lambda k: F.struct((r["cleaned"] + k).alias("key"), (r["original"] + k).alias("value")))
    return F.map_from_entries(F.flatten(F.transform(char_runs(c), pairs)))


#: Characters of a block by which intervals are joined.
BLOCK = 1024


def overlapping(a: DataFrame, b: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Pairs of rows of ``a`` (key, start, end, ...) and ``b`` (key, from, to, ...) whose half-open intervals meet.

    Both are dealt into the blocks they touch and joined by key and block, so the work is that of what meets, not
    of a document's rows times each other. A pair is kept in the first block that both touch.
    """
    last = lambda z: F.floor((F.col(z) - 1) / block).cast("int")
    first = lambda x: F.floor(F.col(x) / block).cast("int")
    dealt = lambda df, x, z: df.filter(F.col(x) < F.col(z)).withColumn("block", F.explode(F.sequence(first(x), last(z))))
    both = dealt(a, "start", "end").join(dealt(b, "from", "to"), [key, "block"])
    return both.filter((F.col("start") < F.col("to")) & (F.col("from") < F.col("end")) & (F.col("block") == F.greatest(first("start"), first("from")))).drop("block")


def originals(elements: DataFrame, runs: DataFrame, key: str, element: str) -> DataFrame:
    """(key, element, start, end) of the original characters of each element, a row for each run that it touches.

    ``elements``: key, element, start, end in the cleaned text. ``runs``: key and a column of ``char_runs``.
    """
    each = runs.select(key, F.inline("runs")).select(key, F.col("cleaned").alias("from"), (F.col("cleaned") + F.col("length")).alias("to"), "original")
    met = overlapping(elements.select(key, element, "start", "end"), each, key)
    lo, hi = F.greatest("start", "from"), F.least("end", "to")
    return met.select(key, element, (F.col("original") + lo - F.col("from")).alias("start"), (F.col("original") + hi - F.col("from")).alias("end"))


def element_coordinates(elements: DataFrame, runs: DataFrame, spans: DataFrame, key: str, element: str) -> DataFrame:
    """Where each element is: page_number, x, y, width, height on the first page that shows it, and its original char_start and char_end.

    ``spans``: key, page_number, from, to (characters of the original text), x0, y0, x1, y1. Elements that no
    span shows, or whose box has no extent, have no row.
    """
    pieces = originals(elements, runs, key, element)
    whole = pieces.groupBy(key, element).agg(F.min("start").alias("char_start"), F.max("end").alias("char_end"))
    met = overlapping(pieces, spans, key)
    by_page = met.groupBy(key, element, "page_number").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("right"), F.max("y1").alias("bottom"))
    box = F.struct("page_number", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))
    return by_page.groupBy(key, element).agg(F.min(box).alias("b")).filter("b.width > 0 AND b.height > 0").join(whole, [key, element]).select(key, element, "b.*", "char_start", "char_end")


def newline_position(index: Column, page: Column, bottom: Column) -> Column:
    """The place of a line feed after a line: x = 0 at the line's bottom, without extent."""
    zero = F.lit(0.0)
    return F.struct(index.alias("char_index"), page.alias("page_number"), zero.alias("x"), bottom.alias("y"), F.struct(zero.alias("x0"), bottom.alias("y0"), zero.alias("x1"), bottom.alias("y1")).alias("bbox"))


def span_positions(text: Column, page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct> with a place for each character of a span, spaced evenly; no Python worker."""
    n = F.length(text)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.transform(at, lambda i: F.struct(i.alias("char_index"), page.alias("page_number"), (x0 + i / n * (x1 - x0)).alias("x"), y0.alias("y"), box.alias("bbox")))
