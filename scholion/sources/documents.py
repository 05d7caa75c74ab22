"""Documents and pages: upload gate, PDF scan with a parser given by the user, page assembly, quality, sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charmap
from ..functions.batches import small_batches
from ..functions.text import let
from . import pdf

# Limits.
MAX_FILE_MB = 50
MIN_TOTAL_CHARS = 100
MIN_MEAN_CHARS = 50

PAGE_SCHEMA = "path string, page_number int, text string, char_count int, width double, height double, error string, message string, seconds double, file_bytes long, parser string"


def upload_status(name: Column, size: Column, max_mb: float = MAX_FILE_MB) -> Column:
    """'ok', 'invalid_type' (no name, or not .pdf) or 'too_large' (a known size over the limit)."""
    named = F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))
    return F.when(~named, "invalid_type").when(F.coalesce(size, F.lit(0)) > int(max_mb * 1024 * 1024), "too_large").otherwise("ok")


def scan_files(spark: SparkSession, path: str, max_mb: float = MAX_FILE_MB) -> DataFrame:
    """Files under ``path`` with a status; the content of those that are not 'ok' is null. Spark's reader leaves out files of no bytes."""
    files = spark.read.format("binaryFile").load(path)
    status = upload_status(F.col("path"), F.col("length"), max_mb)
    return files.select("path", "length", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def scan_pages(files: DataFrame, parse: Callable[[bytes], list[tuple[str, float, float]]]) -> DataFrame:
    """One row per page of each file that is 'ok'; ``parse`` gives (text, width, height) of the pages.

    Each row tells how long the file's parsing took, its size, and the parser's ``version``, if it has one.

    A failure is a row with an error: PasswordProtectedError if the message speaks of a password, else
    CorruptedFileError; no pages ExtractionQualityError; under 100 characters NoTextLayerError.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in PAGE_SCHEMA.split(", ")]
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False, name=None):
                began = time.perf_counter()
                try:
                    pages = parse(content)
                    rows = [(path, i + 1, text, len(text), w, h, None, None) for i, (text, w, h) in enumerate(pages)]
                    if not pages:
                        rows = [(path, None, None, None, None, None, "ExtractionQualityError", "no pages")]
                    elif sum(len(t.strip()) for t, _, _ in pages) < MIN_TOTAL_CHARS:
                        rows = [(path, None, None, None, None, None, "NoTextLayerError", "too little text")]
                except Exception as e:  # noqa: BLE001  any fault of a foreign parser is a row
                    kind = "PasswordProtectedError" if "password" in str(e).lower() else "CorruptedFileError"
                    rows = [(path, None, None, None, None, None, kind, str(e))]
                about = (time.perf_counter() - began, len(content), getattr(parse, "version", None))
                yield pd.DataFrame([(*r, *about) for r in rows], columns=columns)

    small_batches(files.sparkSession)
    return files.filter("status = 'ok'").select("path", "content").mapInPandas(run, PAGE_SCHEMA)


PDF_SCHEMA = (
    "path string, page_number int, width double, height double, lines array<array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>, "
    "error string, message string, seconds double, file_bytes long"
)


_SPAN = pa.struct([("text", pa.string()), *((x, pa.float64()) for x in ("x0", "y0", "x1", "y1"))])
_PAGE = pa.schema([
    ("path", pa.string()), ("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("lines", pa.list_(pa.list_(_SPAN))),
    ("error", pa.string()), ("message", pa.string()), ("seconds", pa.float64()), ("file_bytes", pa.int64()),
])
#: Lines of the pages that a task holds before it hands them on.
HELD_LINES = 10_000


def scan_pdf(files: DataFrame) -> DataFrame:
    """One row per page of each file (path, status, content) that is 'ok', by ``pdf.parse``: lines of spans with their boxes.

    Spark deals the files to tasks; ``assembled`` and ``page_positions`` make text and places of the lines without
    Python. A failure is a row without a page: PasswordProtectedError (encrypted), CorruptedFileError (breaks the
    format), PdfError (not supported, or any other fault), ExtractionQualityError (no pages), NoTextLayerError (too little text).
    """

    def failed(path: str, kind: str, message: str) -> list[tuple]:
        return [(path, None, None, None, None, kind, message)]

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            pages = pdf.parse(content)
        except pdf.Encrypted as e:
            return failed(path, "PasswordProtectedError", str(e))
        except pdf.Malformed as e:
            return failed(path, "CorruptedFileError", str(e))
        except Exception as e:  # noqa: BLE001  one file's fault is its row
            return failed(path, "PdfError", f"{type(e).__name__}: {e}")
        if not pages:
            return failed(path, "ExtractionQualityError", "no pages")
        texts = ("".join("".join(s[0] for s in line) + "\n" for line in lines if any(s[0] for s in line)) for _, _, lines in pages)
        if len("\n".join(texts).strip()) < MIN_TOTAL_CHARS:
            return failed(path, "NoTextLayerError", "too little text")
        return [(path, k + 1, w, h, lines, None, None) for k, (w, h, lines) in enumerate(pages)]

    def arrow(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*held, strict=True), _PAGE, strict=True)], schema=_PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, content, began = path.as_py(), content.as_py(), time.perf_counter()
                found = rows(path, content)
                took = time.perf_counter() - began
                for r in found:
                    held.append((*r, took, len(content)))
                    many += 1 + len(r[4] or ())
                    if many >= HELD_LINES:
                        yield arrow(held)
                        held, many = [], 0
        if held:
            yield arrow(held)

    small_batches(files.sparkSession)
    return files.filter("status = 'ok' AND content IS NOT NULL").select("path", "content").mapInArrow(run, PDF_SCHEMA)


def assembled(pages: DataFrame) -> DataFrame:
    """``pages`` of ``scan_pdf`` with text and char_count."""
    text = page_text(F.transform("lines", lambda line: F.transform(line, lambda s: s["text"])))
    return pages.withColumn("text", text).withColumn("char_count", F.length("text"))


def page_spans(pages: DataFrame, key: str) -> DataFrame:
    """A row for each span of ``assembled`` pages: key, page_number, from, to (in the pages' texts joined by line feeds), x0, y0, x1, y1."""
    before = Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("char_count") + 1).over(before), F.lit(0))
    line_text = lambda line: F.array_join(F.transform(line, lambda s: s["text"]), "")
    sizes = F.transform("lines", lambda line: let(line_text(line), lambda t: F.length(t) + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)))
    summed = lambda counts: F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def of_line(line: Column, at: Column) -> Column:
        ends = summed(F.transform(line, lambda s: F.length(s["text"])))
        return let(ends, lambda e: F.transform(line, lambda s, i: F.struct((at + F.get(e, i)).alias("from"), (at + F.get(e, i + 1)).alias("to"), s["x0"].alias("x0"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["y1"].alias("y1"))))

    offsets = summed(sizes)
    lined = F.flatten(F.transform("lines", lambda line, i: of_line(line, F.get("offsets", i))))
    placed = pages.filter("page_number IS NOT NULL").withColumn("start", start).withColumn("offsets", offsets)
    each = placed.select(key, "page_number", "start", F.inline(lined))
    return each.select(key, "page_number", (F.col("start") + F.col("from")).cast("int").alias("from"), (F.col("start") + F.col("to")).cast("int").alias("to"), "x0", "y0", "x1", "y1")


def page_positions(pages: DataFrame) -> DataFrame:
    """``pages`` with positions: a place for each character of a page's text, spaced evenly in its span; line feeds stand at their line's bottom."""

    def of_line(line: Column) -> Column:
        chars = F.flatten(F.transform(line, lambda s: charmap.span_positions(s["text"], F.col("page_number"), s["x0"], s["y0"], s["x1"], s["y1"])))
        text = F.array_join(F.transform(line, lambda s: s["text"]), "")
        bottom = F.array_max(F.transform(line, lambda s: s["y1"]))
        return F.when((text != "") & ~text.endswith("\n"), F.concat(chars, F.array(charmap.newline_position(F.size(chars), F.col("page_number"), bottom)))).otherwise(chars)

    numbered = F.transform(F.flatten(F.transform("lines", of_line)), lambda p, i: p.withField("char_index", i))
    return pages.withColumn("positions", numbered)


def page_text(lines: Column) -> Column:
    """Text of a page from array<array<string>> of spans by line: a line feed after each line unless there is one, none at the start."""
    joined = F.transform(lines, lambda spans: F.array_join(spans, ""))

    def add(text: Column, line: Column) -> Column:
        both = F.concat(text, line)
        return F.when((both == "") | both.endswith("\n"), both).otherwise(F.concat(both, F.lit("\n")))

    return F.aggregate(joined, F.lit(""), add)


def full_text(pages: DataFrame, key: str) -> DataFrame:
    """Pages joined by line feeds in order, and the number of characters without those."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("full_text"), F.sum("char_count").alias("total_chars"))


def char_at(pages: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The character at a global index over a document's pages, without separators. ``wanted``: key, char_index. Out of range: null.

    An equality join on the key with a range condition; the running sum is over one document's pages.
    """
    before = Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.withColumn("start", F.coalesce(F.sum("char_count").over(before), F.lit(0)))
    at = (F.col("char_index") >= F.col("start")) & (F.col("char_index") < F.col("start") + F.col("char_count"))
    w, p = wanted.alias("w"), placed.alias("p")
    return w.join(p, (F.col(f"w.{key}") == F.col(f"p.{key}")) & at, "left").select(F.col(f"w.{key}").alias(key), "char_index", "page_number", F.substring(F.col("p.text"), (F.col("char_index") - F.col("start") + 1).cast("int"), F.lit(1)).alias("char"))


def quality(pages: DataFrame, key: str) -> DataFrame:
    """valid: enough characters in all and on average, and pages numbered 1..n."""
    return pages.groupBy(key).agg(
        F.count("*").alias("n_pages"), F.sum("char_count").alias("total_chars"),
        (
            (F.sum("char_count") >= MIN_TOTAL_CHARS) & (F.avg("char_count") >= MIN_MEAN_CHARS)
            & (F.min("page_number") == 1) & (F.max("page_number") == F.count("*")) & (F.count_distinct("page_number") == F.count("*"))
        ).alias("valid"),
    )


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_markdown(df: DataFrame, markdown_col: str, path: str) -> None:
    """One export per text row; rows are ended by a form feed so that exports can be told apart."""
    df.select(F.col(markdown_col).alias("value")).write.option("lineSep", "\f").text(path)


def health(spark: SparkSession, version: str = "1", about: DataFrame | None = None) -> DataFrame:
    """One row: status and version, and the columns of ``about`` (one row)."""
    rows = spark.range(1).select() if about is None else about
    return rows.select(F.lit("healthy").alias("status"), F.lit(version).alias("version"), *rows.columns)


def session_id(*parts: Column) -> Column:
    """A repeatable id in the form of a UUID."""
    h = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
