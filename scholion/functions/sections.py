"""Sections of a text: heading lines by their cues, chosen jointly so that sections have something in them.

A line scores as a heading by a mark (``#`` to ``######``), a known name, numbering, blank lines around it, capitals, and
against it, if it has no mark, by length and a stop at its end. Of the lines that score above 0 those are chosen whose scores sum to most, less ``SHORT`` for each
section of under ``LEAST`` characters: by dynamic programming from the first line on, in one pass with a running best.
What stands before the first heading is a section of its own. ``html_lines`` makes lines of HTML, one for each block.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html as tree

# The kind of section that a name stands for; the least size of a section.
NAMES = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "background": "background", "related work": "background", "method": "methods", "methods": "methods", "methodology": "methods",
    "approach": "methods", "experiment": "methods", "experiments": "methods", "results": "results", "findings": "results", "evaluation": "results", "discussion": "discussion", "limitations": "discussion",
    "conclusion": "conclusion", "conclusions": "conclusion", "future work": "conclusion", "acknowledgments": "other", "acknowledgements": "other", "references": "references", "bibliography": "references", "appendix": "other",
}
LEAST = 50
SHORT = 3.0

SECTION = "array<struct<section_type:string,title:string,begin:int,end:int,text:string>>"
_MARK = re.compile(r"^#{1,6}\s+(?=\S)")
_NUMBER = re.compile(r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+(?=\S)")


def kind_of(title: str) -> str:
    """The kind that a title (without a mark) stands for."""
    return NAMES.get(_NUMBER.sub("", title).strip(" :.").lower(), "other")


def score(line: str, after_blank: bool, before_blank: bool) -> float:
    """How much a stripped line looks like a heading; above 0 it may be one."""
    if not line:
        return -1.0
    if _MARK.match(line):
        return 5.0
    bare = _NUMBER.sub("", line)
    words = bare.split()
    long = [w for w in words if len(w) >= 4]
    total = -2.0 + 4.0 * (bare.strip(" :.").lower() in NAMES) + 2.0 * (bare != line) + 1.5 * after_blank + 0.5 * before_blank
    total += 1.0 * bool(long and all(w[0].isupper() for w in long)) - 2.0 * (line[-1] in ".,;!?") - 3.0 * (len(words) > 12) - 0.1 * max(0, len(line) - 60)
    return total


def candidates(text: str) -> list[tuple[int, int, float]]:
    """(begin, end, score) of the lines that may be headings."""
    out, at = [], 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        s = score(line.strip(), k == 0 or not lines[k - 1].strip(), k + 1 < len(lines) and not lines[k + 1].strip())
        if s > 0:
            out.append((at, at + len(line), s))
        at += len(line) + 1
    return out


def chosen(found: list[tuple[int, int, float]], size: int) -> list[int]:
    """The candidates that are headings. Of two candidates in a row the second may be far enough from the first, or cost ``SHORT``."""
    best: list[float] = []
    before: list[int] = []
    far, far_at, seen = 0.0, -1, 0  # the best of those that are at least LEAST away, or none
    for j, (begin, _, s) in enumerate(found):
        while seen < j and begin - found[seen][1] >= LEAST:
            if best[seen] > far:
                far, far_at = best[seen], seen
            seen += 1
        top, at = far, far_at
        for i in range(seen, j):
            if best[i] - SHORT > top:
                top, at = best[i] - SHORT, i
        best.append(top + s)
        before.append(at)
    ends = [b - (SHORT if size - found[k][1] < LEAST else 0.0) for k, b in enumerate(best)]
    k = max(range(len(ends)), key=ends.__getitem__, default=-1)
    if k < 0 or ends[k] <= 0:
        return []
    out = []
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def sections_of(text: str) -> list[dict]:
    found = candidates(text)
    heads = [found[k] for k in chosen(found, len(text))]
    edges = [(0, 0, None), *((a, z, _MARK.sub("", text[a:z].strip())) for a, z, _ in heads)]
    out = []
    for (a, z, title), stop in zip(edges, [*(h[0] for h in heads), len(text)]):
        if title is not None or text[z:stop].strip():
            out.append({"section_type": "other" if title is None else kind_of(title), "title": title, "begin": a, "end": stop, "text": text[z:stop].strip()})
    return out


def sections(c: Column) -> Column:
    """The sections of a text in order; none of a blank one; null for null."""

    @F.pandas_udf(SECTION)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sections_of(t))

    return run(c)


def lines_of_html(html: str) -> str:
    """The text that ``html.sanitize`` keeps, a line for each block, headings marked and between blank lines."""
    out: list[str] = []
    for token in tree.kept(html):
        if token[0] == "text":
            out.append(re.sub(r"\s+", " ", token[1]))
        elif token[1] in tree.HEADINGS:
            out.append("\f" + "#" * int(token[1][1]) + " " if token[0] == "start" else "\f")
        elif token[1] in tree.SPECIAL or token[1] == "br":
            out.append("\n")
    return re.sub(r"[ \n\f]*[\n\f][ \n\f]*", lambda m: "\n\n" if "\f" in m[0] else "\n", "".join(out)).strip()


def html_lines(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else lines_of_html(t))

    return run(html)
