"""Text normalization and splitting as column expressions; no Python worker.

All regular expressions use ``(?U)`` where ``\\s`` or ``\\d`` must be Unicode-aware. ``(?U)\\w`` would take
combining marks too, so the letters of words are spelled out.
Nulls give null. An empty text stays empty (see ``normalize`` for the status).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a citation, as furniture of a page, as an abbreviation.
PROTECTED = r"\[[0-9,\s-]+\]|\([^)]*(?:et al\.|[0-9]{4})[^)]*\)"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FURNITURE = r"copyright|©\s*\d{4}|all rights reserved|acm\s+digital\s+library|doi:"
WEB_PREFIXES = ("http://", "https://", "www.")
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "Dr.", "Prof.", "Fig.", "Eq.")
WORD = r"[\p{L}\p{N}_]"
MIN_CONTENT_CHARS = 5
REPEATED_LINE_CHARS = 100
REPEATED_LINE_COUNT = 3


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends; ``trim`` alone would remove spaces only."""
    return F.btrim(c, F.lit(WHITE))


def dehyphenate(c: Column) -> Column:
    """Join words broken by a hyphen at a line's end; in a chain only every other break is joined."""
    return F.regexp_replace(c, rf"(?U)({WORD})-\s*\n\s*({WORD}+)", "$1$2")


def collapse(c: Column) -> Column:
    """Runs of spaces to one, paragraph breaks to two line feeds, single line feeds to a space."""
    one = F.regexp_replace(c, " {2,}", " ")
    two = F.regexp_replace(one, r"\n{2,}", "\n\n")
    return F.regexp_replace(two, r"(?<!\n)\n(?!\n)", " ")


def normalize_whitespace(c: Column) -> Column:
    """``collapse`` outside protected ranges (citations)."""
    outside = F.transform(F.split(c, PROTECTED, -1), collapse)
    inside = F.regexp_extract_all(c, F.lit(f"({PROTECTED})"), F.lit(1))
    return F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


#: One pass over a stripped line: digits, roman numerals, links, page furniture.
NOT_CONTENT = r"(?iU)^(?:\d+|[ivxlcdm]+)\z|^(?:" + "|".join(w.replace(".", r"\.") for w in WEB_PREFIXES) + ")|" + FURNITURE


def is_content_line(line: Column) -> Column:
    """False for blank, short, numeric and roman-numeral lines, links, and page furniture."""
    s = strip(line)
    return ~((F.length(s) < MIN_CONTENT_CHARS) | s.rlike(NOT_CONTENT))


def repeatable(stripped: Column) -> Column:
    """May a stripped line be a header or footer at all: not blank, short enough, not content."""
    return (F.length(stripped) > 0) & (F.length(stripped) < REPEATED_LINE_CHARS) & ((F.length(stripped) < MIN_CONTENT_CHARS) | stripped.rlike(NOT_CONTENT))


def remove_repeated_lines(c: Column) -> Column:
    """Drop non-content lines that occur three times or more. When any is dropped, leading line feeds go too.

    Only non-content lines are counted: one of them occurs n times if, in order, it comes again n - 1 places on.
    """

    def with_lines(pair: Column) -> Column:
        lines, stripped = pair["lines"], pair["stripped"]
        few = F.array_sort(F.filter(stripped, repeatable))
        often = let(few, lambda f: F.array_distinct(F.filter(f, lambda x, i: F.coalesce(F.get(f, i + (REPEATED_LINE_COUNT - 1)) == x, F.lit(False)))))

        def without(drop: Column) -> Column:
            kept = F.filter(F.arrays_zip(lines.alias("line"), stripped.alias("key")), lambda x: ~F.array_contains(drop, x["key"]))
            return F.when(F.size(drop) > 0, F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\n+", ""))

        return let(often, without)

    split = let(F.split(c, "\n", -1), lambda lines: F.struct(lines.alias("lines"), F.transform(lines, strip).alias("stripped")))
    return F.coalesce(let(split, with_lines), c)


def normalize(c: Column) -> Column:
    """struct(status, original, cleaned, transformations): the three steps in order.

    A step is recorded if it changed the length, so turning one line feed into a space is not.
    An empty text has the status 'empty'.
    """

    def finish(a: Column, b: Column, d: Column) -> Column:
        steps = [(c, a, "hyphenation"), (a, b, "whitespace"), (b, d, "headers_footers")]
        done = F.array_compact(F.array(*[F.when(F.length(x) != F.length(y), F.lit(name)) for x, y, name in steps]))
        return F.struct(F.when(F.length(c) == 0, "empty").when(c.isNotNull(), "ok").alias("status"), c.alias("original"), d.alias("cleaned"), done.alias("transformations"))

    return let(dehyphenate(c), lambda a: let(normalize_whitespace(a), lambda b: let(remove_repeated_lines(b), lambda d: finish(a, b, d))))


def reverse_lookup(mapping: Column, index: Column) -> Column:
    """Original index of a cleaned one, -1 if there is none."""
    return F.coalesce(F.try_element_at(mapping, index), F.lit(-1))


def paragraphs(c: Column) -> Column:
    """Stripped, non-blank paragraphs."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n", -1), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Stripped sentences; known abbreviations do not end one. Middle dots become periods."""
    masked = c
    for word in ABBREVIATIONS:
        masked = F.replace(masked, F.lit(word), F.lit(word.replace(".", "·")))
    parts = F.transform(F.split(masked, r"(?U)(?<=[.!?])\s+(?=[A-Z])", -1), lambda s: strip(F.replace(s, F.lit("·"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down; 0 for null."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4)
