"""BPE encoding and decoding with a contiguous rank array.

A word is held as the list of its part boundaries, and beside it the merge rank of each pair of
neighbouring parts. The least rank is found by scanning, its boundary is deleted, and the ranks
left and right of it are looked up anew. That is quadratic, and best for short words; words of
more than ``SCAN_LIMIT`` bytes use the same merges in the same order through a heap.

The tokenizer file is read on the driver and broadcast (its size is that of the vocabulary). Every
worker keeps the encodings of the words it has met, up to ``CACHE_WORDS``; then it starts anew.

Defined cases: null counts as empty; an empty text has no ids, and the digest of ''; strings of
special tokens in a text become their ids; rows repeat as in the input; very long texts are
encoded whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

SCAN_LIMIT = 128
CACHE_WORDS = 600_000
NO_RANK = 1 << 60
#: A text of printable ASCII, line feeds, tabs and Latin-1 letters alone splits alike, and faster, by PLAIN_PATTERN.
PLAIN_PATTERN = r" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9a-zA-ZÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
NOT_PLAIN = r"[^ -~\n\tÀ-ÖØ-öø-ÿ]"
#: Fixed value: the public pattern by which byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """ids of byte strings, ranks of merges, special tokens."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, letters = spec["model"], byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {raw(s): i for s, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[tuple[bytes, bytes], int] = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}


class Words(dict):
    """ids of each word met; a word that is not there is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.encode(word.encode("utf-8")))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= SCAN_LIMIT:
            self[word] = found
        return found


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.any_text, self.plain_text, self.not_plain = regex.compile(PATTERN), re.compile(PLAIN_PATTERN), re.compile(NOT_PLAIN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.cache = Words(self.word)
        self.single = [v.ids[bytes([b])] for b in range(256)]
        # a pair of neighbouring parts by their ids, as one number
        self.ranks = {(v.ids[a] << 32) | v.ids[b]: k for (a, b), k in v.ranks.items()}
        self.merged = {k: v.ids[a + b] for (a, b), k in v.ranks.items()}
        self.bytes = [v.bytes.get(i, b"") for i in range(max(v.bytes) + 1)]
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def word(self, raw: bytes) -> list[int]:
        if len(raw) <= SCAN_LIMIT:
            return self.scan(raw)[1]
        bounds = self.heap(raw)
        return [self.v.ids[raw[a:b]] for a, b in zip(bounds, bounds[1:])]

    def scan(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Boundaries and ids of the parts that are left when no rank is."""
        get, single = self.ranks.get, self.single
        bounds = list(range(len(raw) + 1))
        parts = [single[b] for b in raw]
        ranks = [get((a << 32) | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            del bounds[i + 1], parts[i + 1], ranks[i]
            parts[i] = here = self.merged[low]
            if i < len(ranks):
                ranks[i] = get((here << 32) | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1] << 32) | here, NO_RANK)
        return bounds, parts

    def heap(self, raw: bytes) -> list[int]:
        """Same merges, least rank first and the leftmost of equals, in n log n."""
        get, n = self.v.ranks.get, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        alive = [True] * n
        todo = [(r, i, i + 2) for i in range(n - 1) if (r := get((raw[i : i + 1], raw[i + 1 : i + 2]))) is not None]
        heapq.heapify(todo)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := get((raw[i:j], raw[j : end[j]]))) is not None:
                heapq.heappush(todo, (r, i, end[j]))

        while todo:
            _, i, stop = heapq.heappop(todo)
            if not alive[i] or (j := end[i]) >= n or not alive[j] or end[j] != stop or get((raw[i:j], raw[j:stop])) != _:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in range(n) if alive[i]] + [n]

    def split(self, text: str) -> list[str]:
        return (self.any_text if self.not_plain.search(text) else self.plain_text).findall(text)

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not self.specials.search(text):
            return list(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))
        out: list[int] = []
        for part in self.specials.split(text):
            if part in self.v.special:
                out.append(self.v.special[part])
            else:
                out += chain.from_iterable(map(self.cache.__getitem__, self.split(part)))
        return out

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_CODECS: dict[int, Codec] = {}


def worker_codec(shared) -> Codec:
    """The one codec of this worker process, kept from task to task."""
    v = shared.value
    if id(v) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(v)] = Codec(v)
    return _CODECS[id(v)]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text; ``with_ids`` adds the ids and the decoded text. No shuffle."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(tokenizer))

    def run(batches):
        codec = worker_codec(shared)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
            for t in batch["text"]:
                ids = codec.encode(t if isinstance(t, str) else "")
                text = codec.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(codec.digest(ids))
                out["decoded_sha256"].append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(text)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")} | out)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))
