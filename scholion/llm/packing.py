"""Best-fit packing of token sequences into bins of several permitted lengths.

A text's units are the ids of its tokens, by a public vocabulary of ranks or as given in a column, and one
end token. It is cut into pieces of the longest permitted length and a rest. Pieces are dealt into shards by
a hash of the row's id and text, so null or repeated ids spread; rows that a task meets again go by their
number too, so equal rows spread as well. A shard is sorted from the longest piece down and gathered as it
streams by. A bin of length c costs ``c * (1 + c / ATTENTION)``; the lengths are chosen jointly, for a shard as a whole:

* Plans. Best fit puts each piece into the open bin with the least room that is enough; plans differ in what is
  opened when none is: the shortest length that fits, no shorter than each permitted one in turn (so the shortest
  and the longest alone are among them), or the one that costs least for each unit it can be expected to hold. One more
  plan fills a bin at a time: around the longest piece left, the sums that other pieces can make are
  searched for the length and the filling of least cost for each unit.
* Every plan's bins are downsized to the shortest permitted length that holds their contents, and the cheapest plan
  is kept; so no single rule among them is better.
* The bins with the most padding, ``WINDOWS`` times as many as have ``WINDOW`` pieces, are dealt anew by an exact search
  over all partitions of their pieces. A shard of up to ``WINDOW`` pieces is thus packed at the least cost there is.

Every unit is in one bin, and no bin holds more than its length. The packed sequences are rows: their
ids, and for each piece in them the document, where it starts in it, where it lies in the bin, its length.
Where no row is repeated, bins and their ids depend on the rows alone, not on partitions.

Memory: up to ``SHARD`` pieces of the longest length; a shard that has more is packed as several. Arrow
batches go in and out, so no id is a Python object for longer than its text is encoded.

Defined cases: strings of special tokens in a text are plain text; a null or empty text has no units and a row with bin_id null, as has a null or empty list
of given tokens; ties are broken by id, then by start, then by the row's hash; repeated rows and null ids
are packed like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import small_batches

LENGTHS = (512, 1024, 2048, 4096)
ATTENTION = 32768
SHARD = 2048
#: Pieces that are partitioned exactly at once, and how often in a shard.
WINDOW, WINDOWS = 8, 24
#: Pieces, of all sizes left, whose sums are searched for the filling of a bin.
CANDIDATES = 48
#: Bins in one Arrow batch of results.
SLICE = 256

PIECES = "shard long, doc_id long, start long, n_units int, row long, ids binary"
SCHEMA = "bin_id string, bin_length int, n_units int, ids array<int>, doc_ids array<long>, starts array<long>, offsets array<int>, sizes array<int>"


def cost(c: int) -> float:
    return c * (1.0 + c / ATTENTION)


def expected(size: int, left: int, smallest: int, lengths: tuple[int, ...]) -> int:
    """The length that costs least for each unit it can be expected to hold, given what is left to pack."""
    best, chosen = math.inf, 0
    for c in lengths:
        if c >= size:
            more = min(c - size, left) if c - size >= smallest else 0
            if (each := cost(c) / (size + more)) < best:
                best, chosen = each, c
    return chosen


def best_fit(sizes: list[int], lengths: tuple[int, ...], least: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """``sizes`` from the largest down: bin and offset of each piece, fill of each bin. ``least``: the shortest length to open; ``expected`` if null."""
    top = max(lengths)
    rooms: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by room
    some = 0  # bit r is set if a bin has room r
    bins, offsets, fills, capacity = [], [], [], []
    left, smallest = sum(sizes), sizes[-1] if sizes else 0
    for size in sizes:
        left -= size
        above = some >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            k = len(fills)
            fills.append(0)
            capacity.append(expected(size, left, smallest, lengths) if least is None else min(c for c in lengths if c >= size and c >= least))
        bins.append(k)
        offsets.append(fills[k])
        fills[k] += size
        room = capacity[k] - fills[k]
        if room:
            rooms[room].append(k)
            some |= 1 << room
    return bins, offsets, fills


def filled(sizes: list[int], lengths: tuple[int, ...]) -> list[int]:
    """The bin of each piece, a bin at a time around the longest piece left, by the sums that other pieces can make."""
    bins, number = [-1] * len(sizes), 0
    left = list(range(len(sizes)))  # from the largest down
    while left:
        first, rest = left[0], left[1:]
        picked = [rest[k * len(rest) // CANDIDATES] for k in range(CANDIDATES)] if len(rest) > CANDIDATES else rest
        reach, mask = [1], (1 << (lengths[-1] - sizes[first] + 1)) - 1
        for k in picked:
            reach.append((reach[-1] | reach[-1] << sizes[k]) & mask)
        best, more = math.inf, 0
        for c in lengths:
            if c >= sizes[first]:
                fill = (reach[-1] & ((1 << (c - sizes[first] + 1)) - 1)).bit_length() - 1
                if (each := cost(c) / (sizes[first] + fill)) < best:
                    best, more = each, fill
        own = {first}
        for n in range(len(picked), 0, -1):  # which pieces make that sum
            if not reach[n - 1] >> more & 1:
                own.add(picked[n - 1])
                more -= sizes[picked[n - 1]]
        for k in own:
            bins[k] = number
        number += 1
        left = [k for k in left if k not in own]
    return bins


def partition(sizes: list[int], lengths: tuple[int, ...]) -> list[list[int]]:
    """The partition of a few pieces into bins that costs least, by all subsets."""
    n = len(sizes)
    total = [0] * (1 << n)
    for m in range(1, 1 << n):
        low = m & -m
        total[m] = total[m ^ low] + sizes[low.bit_length() - 1]
    price = [next((cost(c) for c in lengths if c >= t), math.inf) for t in total]
    best, chosen = [0.0] * (1 << n), [0] * (1 << n)
    for m in range(1, 1 << n):
        low, found = m & -m, math.inf
        sub = m
        while sub:
            if sub & low and price[sub] + best[m ^ sub] < found - 1e-9:
                found, chosen[m] = price[sub] + best[m ^ sub], sub
            sub = (sub - 1) & m
        best[m] = found
    out, m = [], (1 << n) - 1
    while m:
        out.append([k for k in range(n) if chosen[m] >> k & 1])
        m ^= chosen[m]
    return out


def mended(groups: list[list[int]], sizes: list[int], lengths: tuple[int, ...]) -> list[list[int]]:
    """``groups`` (the pieces of each bin) with those of most padding dealt anew, window by window."""
    length = lambda own: min(c for c in lengths if c >= sum(sizes[k] for k in own))
    padding = lambda own: length(own) - sum(sizes[k] for k in own)
    kept, windows, many = [], [[]], 0
    for own in sorted(groups, key=lambda own: (-padding(own), own)):
        if many + len(own) > WINDOW and len(own) <= WINDOW and len(windows) < WINDOWS:
            windows.append([])
            many = 0
        if many + len(own) <= WINDOW:
            windows[-1].append(own)
            many += len(own)
        else:
            kept.append(own)
    for window in windows:
        pieces = sorted(k for own in window for k in own)
        anew = [[pieces[k] for k in own] for own in partition([sizes[k] for k in pieces], lengths)]
        price = lambda some: sum(cost(length(own)) for own in some)
        kept += anew if price(anew) < price(window) - 1e-9 else window
    return kept


def grouped_by(bins: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for k, b in enumerate(bins):
        out.setdefault(b, []).append(k)
    return list(out.values())


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (``sizes`` from the largest down), and the length of each bin, at the least cost found."""
    if not sizes:
        return [], [], []
    price = lambda groups: sum(cost(min(c for c in lengths if c >= sum(sizes[k] for k in own))) for own in groups)
    plans = [grouped_by(best_fit(sizes, lengths, least)[0]) for least in (None, *lengths)] + [grouped_by(filled(sizes, lengths))]
    groups = mended(min(plans, key=price), sizes, lengths)
    bins, offsets, final = [0] * len(sizes), [0] * len(sizes), []
    for b, own in enumerate(sorted(groups, key=min)):
        at = 0
        for k in sorted(own):
            bins[k], offsets[k] = b, at
            at += sizes[k]
        final.append(min(c for c in lengths if c >= at))
    return bins, offsets, final


#: White space beyond which the library's own splitting may fail; such texts are split here, by the same pattern.
LONG_SPACE = re.compile(r"\s{1000}")
_WORDS = regex.compile(PATTERN)


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_ENCODERS: dict[int, tiktoken.Encoding] = {}


def worker_encoder(shared) -> tiktoken.Encoding:
    """The one encoder of this worker process, kept from task to task."""
    ranks = shared.value
    if id(ranks) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(ranks)] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[id(ranks)]


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    if LONG_SPACE.search(text):
        return list(chain.from_iterable(map(encoder._encode_single_piece, _WORDS.findall(text))))
    return encoder.encode_ordinary(text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def sequences(name: str, rows: list[tuple], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Bins of the pieces ``rows`` (doc_id, start, ids), from the longest down; those without units, which are last, have no bin."""
    sizes = [len(r[2]) for r in rows if len(r[2])]
    bins, offsets, final = pack(sizes, lengths)
    within: list[list[int]] = [[] for _ in final]
    for k, b in enumerate(bins):
        within[b].append(k)
    names: list[str | None] = [f"{name}-{b}" for b in range(len(final))]
    rest = len(rows) - len(sizes)
    within, names, final = within + [[k] for k in range(len(sizes), len(rows))], names + [None] * rest, final + [None] * rest
    sizes, offsets = sizes + [0] * rest, offsets + [0] * rest
    for at in range(0, len(within), SLICE):
        part = within[at : at + SLICE]
        order, many = [k for own in part for k in own], [len(own) for own in part]
        units = [sum(sizes[k] for k in own) for own in part]
        ids = np.concatenate([rows[k][2] for k in order])
        columns = [
            pa.array(names[at : at + SLICE], pa.string()), pa.array(final[at : at + SLICE], pa.int32()), pa.array(units, pa.int32()), lists(ids, units, pa.int32()),
            lists([rows[k][0] for k in order], many, pa.int64()), lists([rows[k][1] for k in order], many, pa.int64()),
            lists([offsets[k] for k in order], many, pa.int32()), lists([sizes[k] for k in order], many, pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["bin_id", "bin_length", "n_units", "ids", "doc_ids", "starts", "offsets", "sizes"])


def pieces_of(docs: DataFrame, vocabulary: str | None, id_col: str, text_col: str, tokens_col: str | None, end: int | None, shards: int, top: int) -> DataFrame:
    """The pieces of every row with their shards; ``ids`` as little-endian 32-bit numbers."""
    ranks = None if tokens_col else ranks_of(vocabulary)
    stop = max(ranks.values()) + 1 if end is None and ranks else end
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    given = F.col(tokens_col).cast("array<int>") if tokens_col else F.col(text_col)

    def run(batches):
        encoder = None if tokens_col else worker_encoder(shared)
        met: Counter = Counter()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, what in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array((what if tokens_col else encode(encoder, what)) if what else [], np.int32)
                raw = ids.tobytes()
                if len(ids) and stop is not None:
                    ids = np.append(ids, np.int32(stop))
                row = xxhash.xxh3_64_intdigest(raw, seed=0 if doc is None else (doc + 1) & ((1 << 64) - 1))
                turn = met[row]
                met[row] += 1
                for k in range(max(1, -(-len(ids) // top))):
                    piece = ids[k * top : (k + 1) * top]
                    shard = xxhash.xxh3_64_intdigest(f"{row} {turn} {k}") % shards
                    for column, value in zip(out, (shard, doc, k * top, len(piece), signed(row), piece.tobytes()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["shard", "doc_id", "start", "n_units", "row", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), given.alias("given")).mapInArrow(run, PIECES)


def packed(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, tokens_col: str | None = None, end: int | None = None
) -> DataFrame:
    """One row for each bin. ``vocabulary``: the rank file for texts; or ``tokens_col``: a column of ids. ``end``: the end token, for texts the number after the last rank if null."""
    small_batches(docs.sparkSession)
    lengths, top = tuple(sorted(set(lengths))), max(lengths)
    shards = max(1, -(-docs.count() // SHARD))
    pieces = pieces_of(docs, vocabulary, id_col, text_col, tokens_col, end, shards, top)
    ordered = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("n_units"), "doc_id", "start", "row").select("shard", "doc_id", "start", "ids")

    def run(batches):
        held, at, part = [], None, 0
        for batch in batches:
            for shard, doc, start, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if held and (shard != at or len(held) == SHARD):
                    yield from sequences(f"{at}-{part}", held, lengths)
                    held, part = [], part + 1 if shard == at else 0
                at = shard
                held.append((doc, start, np.frombuffer(ids.as_buffer(), np.int32)))
        if held:
            yield from sequences(f"{at}-{part}", held, lengths)

    return ordered.mapInArrow(run, SCHEMA)
