"""WARC archives: writing, reading back, and assembly of transactions.

``write`` gives each row of pages three records: a request, a response (or a revisit of the first row
that has the same payload) and metadata, tied together by ``WARC-Concurrent-To``. Records are text
lines ended by the two line breaks that end a WARC record, so Spark's own text writer makes the
archives, on any file system, with its commit protocol. Payloads are shuffled once, by a key of the
row, whatever the sizes. ``read`` takes archives, plain or gzip with one or many members, parses
records by their ``Content-Length`` as they are inflated, and digests the payloads it has read.
``assemble`` joins request, response and metadata records of a capture, whichever of them names the
other, also by way of any number of others, and emits one nested row per capture. A record that names
several captures is in each of them.

Archives have ``RECORDS_PER_FILE`` records at most, fewer where pages are long, for ``ARCHIVE_BYTES`` on
average. A file of up to ``WHOLE_BYTES`` is read as one row. Longer ones in gzip are streamed by Spark's text reader,
piece by piece between blank lines, and put together by their lengths, so a task holds one record of a
file; longer ones that are not compressed, which that reader would split, are one row too. A capture's row holds the records that
name it.

Defined cases: a null html is an empty payload (empty payloads revisit each other like others); a
null url is the empty URI; of rows with one payload that of the least page_id is the response, null ids
come last, and ties go by a digest of the row; equal rows are records of their own; records of a
repeated id count once; what cannot be parsed is a row with ``error`` and no id, after which the rest of
that file is left; request and metadata records that lead to no response make a capture without one,
together if they name each other; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

RECORDS_PER_FILE = 2000
ARCHIVE_BYTES = 64 << 20
WHOLE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, declared_digest string, "
    "content_type string, block_bytes long, payload_bytes long, payload_digest string, fields map<string,string>, error string"
)


def sha1_base32(raw: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, in JVM expressions: four times 40 bits are eight letters each."""
    hexed = F.sha1(raw)
    parts = [F.lpad(F.conv(F.substring(hexed, part * 10 + 1, 10), 16, 32), 8, "0") for part in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _ALPHABET)


def record_uri(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its end. Headers whose value is null are left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in headers]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.0"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``."""
    page, html = F.col("page_id").cast("long"), F.coalesce(F.col("html"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "+")
    rows = pages.select(page.alias("page_id"), uri.alias("uri"), html.alias("html"), sha1_base32(html.cast("binary")).alias("digest"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", "uri")))
    # both are tables by the time they are joined, so that Spark can split a payload that very many rows share
    scratch = Scratch(pages.sparkSession, "warc-plan")
    kinds = scratch.keep("kinds", rows.groupBy("key", "page_id", "digest").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")))
    first = kinds.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")).alias("first"))
    plan = kinds.join(scratch.keep("first", first), "digest").select("key", "n", F.col("first.key").alias("owner"))
    # equal rows meet before anything is moved, so no key has more than a row of each task
    ready = rows.dropDuplicates(["key"]).join(plan, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    again = (F.col("key") != F.col("owner")) | (F.col("copy") > 1)
    name = F.concat_ws(":", "key", "copy")
    request, response, about = (record_uri(kind, name) for kind in ("request", "response", "metadata"))
    host = F.coalesce(F.nullif(F.regexp_extract("uri", r"^[a-z]+://([^/]*)", 1), F.lit("")), F.lit("localhost"))
    where = F.coalesce(F.nullif(F.regexp_extract("uri", r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    date = ("WARC-Date", F.lit(DATE))
    target = ("WARC-Target-URI", F.col("uri"))
    asked = record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), date, target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), where, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    answered = record(
        [
            ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", response), date, target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(again, PROFILE)), ("WARC-Refers-To", F.when(again, record_uri("response", F.concat(F.col("owner"), F.lit(":1"))))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(again, head).otherwise(F.concat(head, "html")),
    )
    told = record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", about), date, target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    lines = ready.select(F.concat(asked, F.lit(END), answered, F.lit(END), told).alias("value"))
    about = kinds.agg(F.sum("bytes"), F.sum("n")).first()
    pages_per_file = max(1, min(records_per_file // 3, ARCHIVE_BYTES * (about[1] or 1) // max(1, about[0] or 0)))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", pages_per_file).text(path)
    scratch.drop("kinds", "first")


def parse(content: bytes, blocks: bool = True) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, one at a time; only the headers of one without ``blocks``."""
    raw = io.BytesIO(content)
    data = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := data.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:20]!r}")
        headers: dict[str, list[str]] = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", errors="replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        if "content-length" not in headers or "warc-type" not in headers:
            raise ValueError("a record without a length or a type")
        if not blocks:
            yield headers, b""
            return
        block = data.read(int(headers["content-length"][0]))
        if len(block) < int(headers["content-length"][0]):
            raise ValueError("an archive ends inside a record")
        yield headers, block


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def describe(headers: dict[str, list[str]], block: bytes) -> tuple:
    kind, media = headers["warc-type"][0], headers.get("content-type", [""])[0]
    payload = block
    if media.startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    fields = [line.partition(":") for line in block.decode("utf-8", errors="replace").split("\r\n") if ":" in line] if media.startswith("application/warc-fields") else []
    one = lambda name: headers.get(name, [None])[0]
    return (
        one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), headers.get("warc-concurrent-to", []), one("warc-refers-to"),
        one("warc-payload-digest"), media, len(block), len(payload), digest(payload), {k.strip(): v.strip() for k, _, v in fields}, None,
    )


class Stream:
    """Records of an archive that comes in pieces, in order."""

    def __init__(self):
        self.held, self.headers, self.size, self.begun = bytearray(), None, 0, False

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
        """What stands between two blank lines; yields the records that are whole then."""
        if self.begun:
            self.held += END.encode()
        self.begun = True
        self.held += piece
        while True:
            if self.headers is None:
                while self.held[:2] == b"\r\n":
                    del self.held[:2]
                end = self.held.find(END.encode())
                if end < 0:
                    return
                self.headers = next(parse(bytes(self.held[: end + 4]), False))[0]
                self.size = int(self.headers["content-length"][0])
                del self.held[: end + 4]
            if len(self.held) < self.size:
                return
            block = bytes(self.held[: self.size])
            del self.held[: self.size]
            headers, self.headers = self.headers, None
            yield headers, block

    def close(self) -> None:
        if self.headers is not None or self.held.strip():
            raise ValueError("an archive ends inside a record")


_NAMES = [part.strip().split()[0] for part in RECORD_SCHEMA.replace("map<string,string>", "map").split(", ")]


def fault(e: Exception) -> tuple:
    return (*[None] * (len(_NAMES) - 1), f"{type(e).__name__}: {e}")


def read(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The records of all archives under ``path``, without their payloads."""

    def records(content: bytes) -> Iterator[tuple]:
        try:
            for headers, block in parse(content):
                yield describe(headers, block)
        except (ValueError, EOFError, OSError, zlib.error) as e:  # a foreign archive's fault is a row
            yield fault(e)

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(records(content)), columns=_NAMES)

    def streamed(batches):
        at, stream = None, None

        def ended() -> list[tuple]:
            try:
                if stream is not None:
                    stream.close()
            except ValueError as e:
                return [fault(e)]
            return []

        for batch in batches:
            out: list[tuple] = []
            for name, piece in batch.itertuples(index=False, name=None):
                if name != at:
                    out += ended()
                    at, stream = name, Stream()
                if stream is not None:
                    try:
                        out += [describe(*x) for x in stream.feed(bytes(piece))]
                    except ValueError as e:  # the rest of that file is left
                        out.append(fault(e))
                        stream = None
            yield pd.DataFrame(out, columns=_NAMES)
        yield pd.DataFrame(ended(), columns=_NAMES)

    files = spark.read.format("binaryFile").load(path)
    long = [r["path"] for r in files.filter((F.col("length") > whole_bytes) & F.col("path").endswith(".gz")).select("path").collect()]
    short = files.filter("length > 0").filter((F.col("length") <= whole_bytes) | ~F.col("path").endswith(".gz"))
    found = short.select("content").mapInPandas(run, RECORD_SCHEMA)
    if not long:
        return found
    pieces = spark.read.option("lineSep", END).option("ignoreCorruptFiles", True).text(long).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return found.unionByName(pieces.mapInPandas(streamed, RECORD_SCHEMA))


def indirect(links: DataFrame, rest: DataFrame, placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, capture) of the records ``rest`` (id), which no capture's own record is tied to.

    ``links``: (id, via), both ways. Those tied to each other go together, to every capture of the ``placed``
    (id, capture) records that one of them is tied to; where there is none, to that named after their least id.
    """
    own = links.join(rest, "id", "left_semi")
    inner = own.join(rest.withColumnRenamed("id", "via"), "via", "left_semi").select(F.col("id").alias("a"), F.col("via").alias("b"))
    grouped = scratch.keep("grouped", rest.join(components(inner), "id", "left").select("id", F.coalesce("component", "id").alias("group")))
    met = own.join(placed.withColumnRenamed("id", "via"), "via").join(grouped, "id").select("group", "capture").distinct()
    return grouped.join(met, "group", "left").select("id", F.coalesce("capture", "group").alias("capture"))


def assemble(records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per capture: capture_id, request (the least by record id), response (structs), metadata, requests (arrays of structs, by record id).

    ``records`` is read more than once: give a table. Captures are found on ids alone; the records are moved
    once to their captures' ids, and once to the captures.
    """
    scratch = scratch or Scratch(records.sparkSession, "captures")
    body = F.struct("record_id", "type", "target_uri", "date", "refers_to", "declared_digest", "content_type", "block_bytes", "payload_bytes", "payload_digest", "fields")
    known = records.filter("record_id IS NOT NULL")
    first = F.col("type").isin("response", "revisit", "resource")
    ids = known.select("record_id", F.struct((~first).alias("other"), F.array_distinct("concurrent_to").alias("to")).alias("x")).groupBy("record_id").agg(F.min("x").alias("x"))
    ids = scratch.keep("ids", ids.select(F.col("record_id").alias("id"), "x.other", "x.to"))
    main, other = ids.filter("NOT other"), ids.filter("other")
    named = lambda df, a, b: df.filter("size(to) > 0").select(F.col("id").alias(a), F.explode("to").alias(b))
    direct = named(other, "id", "capture").join(main.select(F.col("id").alias("capture")), "capture", "left_semi").select("id", "capture")
    direct = scratch.keep("direct", direct)
    back = named(main, "capture", "id").join(other.select("id"), "id", "left_semi").join(direct, ["id", "capture"], "left_anti").select("id", "capture")
    placed = direct.union(scratch.keep("back", back))
    rest = scratch.keep("rest", other.select("id").join(placed, "id", "left_anti"))
    if rest.limit(1).count():
        links = named(other, "id", "via").union(named(other, "via", "id"))
        placed = placed.union(scratch.keep("indirect", indirect(links, rest, placed, scratch)))
    all_placed = placed.union(main.select("id", F.col("id").alias("capture")))
    rows = known.dropDuplicates(["record_id"]).join(all_placed.withColumnRenamed("id", "record_id"), "record_id").select(F.col("capture").alias("capture_id"), "type", body.alias("r"))
    ordered = lambda name: F.array_sort(name, lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    pick = lambda cond: F.min_by("r", F.when(cond, F.col("r.record_id")))
    return rows.groupBy("capture_id").agg(
        F.when(F.max((F.col("type") == "request").cast("int")) == 1, pick(F.col("type") == "request")).alias("request"),
        F.when(F.max(first.cast("int")) == 1, pick(first)).alias("response"),
        F.collect_list(F.when(~first & (F.col("type") != "request"), F.col("r"))).alias("metadata"),
        F.collect_list(F.when(F.col("type") == "request", F.col("r"))).alias("requests"),
    ).withColumns({"metadata": ordered("metadata"), "requests": ordered("requests")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives, read them back, assemble, and tell what each page's capture says.

    The archives are deleted once their records are a table.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    archives = f"{scratch.root}/archives"
    write(pages, archives)
    records = scratch.keep("records", read(spark, archives))
    scratch.drop("archives")
    captures = assemble(records, scratch)
    flat = captures.select("capture_id", F.element_at("metadata", 1)["fields"]["pageId"].cast("long").alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("d"), F.col("response.target_uri").alias("target_uri"))
    flat = scratch.keep("flat", flat)
    scratch.drop_all_but("flat")
    origin = flat.filter("record_type = 'response'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("n").alias("n0"), F.col("d").alias("d0"))
    return flat.join(origin, "to", "left").select(
        "page_id", F.coalesce("n0", "n").alias("payload_bytes"), F.coalesce("d0", "d").alias("payload_digest"), "record_type", "refers_to", "target_uri",
    )
