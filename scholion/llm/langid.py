"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built of a bounded sample of its labelled texts. A text is
parsed against each automaton: from where the last phrase ended, the longest match is the next
phrase. Few phrases mean that the text is made of long pieces of that language. The number of
phrases, normalised by ``log2`` of the sample's length over the text's length, is the cross-parsing
entropy in bits a character; the language with the least wins (ties: the first in order).

Each automaton becomes a table of transitions over the letters of its own sample, all of them, in
which a failing transition has been resolved to the state after the mismatching character, marked by
its complement; so many texts are parsed at once with array operations. Letters are folded to lower
case, all else is a word break. A long text is parsed in segments of ``SEGMENT`` characters at once, each
as if a phrase began there; then the segments are taken up where the one before really ended, until both
parses are in the same state, from where on they agree. So phrases run on across segments, and the
number is that of one parse of the whole text. Nothing is skipped.

Learning reads at most ``DOCS_PER_LANG`` documents of each language (those with the least hash of
their id, one text of each) and of these no more than come first within twice ``CHARS_PER_LANG``
characters; it uses whole ones up to ``CHARS_PER_LANG`` characters. A longer one is read where there
are not enough others, and its beginning fills what room is left. Any number of languages is learnt; beyond
``TOTAL_CHARS / CHARS_PER_LANG`` of them (66) each sample gets an equal share of ``TOTAL_CHARS``, so what is collected,
built on the driver and broadcast has a bound however many languages there are.
The tables are broadcast. A dense one takes ``states * letters * 4`` bytes; those of the fewest letters
are dense as long as all together stay within ``DENSE_BYTES``, the others are sorted lists of the
transitions there are (at most about ``3 * CHARS_PER_LANG`` of 12 bytes). Both give the same phrases.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows
all are ``und``; repeated rows, null ids and null labels are allowed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, remainder, small_batches

DOCS_PER_LANG = 48
CHARS_PER_LANG = 60_000
#: Characters of all samples together: beyond that many languages, each has its share.
TOTAL_CHARS = 4_000_000
DENSE_BYTES = 256 << 20
SEGMENT = 2048
WORK_CHARS = 6_000_000
UND = "und"
FOLDS, HELD = 4, 2

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, phrases array<int>"


class SuffixAutomaton:
    """States, transitions and suffix links of all substrings of one sequence."""

    def __init__(self, codes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in codes:
            last = self.extend(last, c)

    def extend(self, last: int, c: int) -> int:
        new = self.add({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self.add(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def add(self, out: dict[int, int], length: int) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(-1)
        return len(self.next) - 1


class Dense:
    """Transitions of one automaton as a matrix of states and letters."""

    def __init__(self, automaton: SuffixAutomaton, width: int):
        t = np.full((len(automaton.next), width), -1, np.int64)
        for s, out in enumerate(automaton.next):
            for c, to in out.items():
                t[s, c] = to
        restart = np.where(t[0] >= 0, t[0], 0)
        self.width, self.table = width, np.where(t >= 0, t, ~restart[None, :]).astype(np.int32).ravel()

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.table.take(state.astype(np.int64) * self.width + c)


class Sparse:
    """The same as a sorted list of the transitions that do not fail."""

    def __init__(self, automaton: SuffixAutomaton, width: int):
        found = sorted((s * width + c, to) for s, out in enumerate(automaton.next) for c, to in out.items())
        self.keys, self.to = np.array([k for k, _ in found], np.int64), np.array([to for _, to in found], np.int32)
        self.width, self.restart = width, np.zeros(width, np.int32)
        for c, to in automaton.next[0].items():
            self.restart[c] = to

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], ~self.restart[c])


class Model:
    """langs: in order. lookup: class of each character over all samples. own: by language, its code of each class."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        folded = {k: fold(samples[k]) for k in self.langs}
        alphabet = {c: k for k, c in enumerate(sorted({" "}.union(*map(set, folded.values()))))}
        self.lookup = np.full(0x110000, len(alphabet), np.min_scalar_type(len(alphabet)))  # the last class: letters that no sample has
        for c, k in alphabet.items():
            self.lookup[ord(c)] = k
        self.bits = [math.log2(max(2, len(folded[k]))) for k in self.langs]
        self.own, self.tables = [], [None] * len(self.langs)
        letters = [{c: n for n, c in enumerate(sorted(set(folded[k])))} for k in self.langs]
        for codes in letters:
            own = np.full(len(alphabet) + 1, len(codes), np.min_scalar_type(len(codes)))  # the last code: letters that this sample lacks
            for c, n in codes.items():
                own[alphabet[c]] = n
            self.own.append(own)
        room = DENSE_BYTES
        for k in sorted(range(len(self.langs)), key=lambda k: len(letters[k])):
            automaton, width = SuffixAutomaton([letters[k][c] for c in folded[self.langs[k]]]), len(letters[k]) + 1
            room -= len(automaton.next) * width * 4
            self.tables[k] = (Dense if room >= 0 else Sparse)(automaton, width)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.lookup[points]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text by each language."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if texts else lengths
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[owner] + within * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
        order = np.argsort(-size, kind="stable")
        sorted_at, sorted_size = at[order], size[order]
        active = np.searchsorted(-sorted_size, -np.arange(1, sorted_size[0] + 1), side="right") if len(size) else []
        later = np.flatnonzero(within > 0)
        for k, table in enumerate(self.tables):
            own = self.own[k][flat]
            state = np.zeros(len(at), np.int32)
            fails = np.zeros(len(at), np.int32)
            for step, n in enumerate(active):
                v = table.step(state[:n], own[sorted_at[:n] + step])
                failed = v >> 31  # -1 where the match ends
                fails[:n] -= failed
                state[:n] = v ^ failed
            end, ends = np.empty_like(state), np.empty_like(fails)
            end[order], ends[order] = state, fails
            self.carry(table, own, at, size, later, end, ends)
            # and the phrase that the end cuts short
            out[k] = np.bincount(owner, weights=ends, minlength=len(texts)).astype(np.int64) + (lengths > 0)
        return out

    @staticmethod
    def carry(table, own, at, size, later, end, fails) -> None:
        """Take up the segments ``later`` where those before them ended: corrects ``end``, the last states, and ``fails``."""
        begun = np.zeros(len(at), np.int32)  # the state that a segment has been parsed from
        todo = later[end[later - 1] != 0]
        while len(todo):
            a, b = end[todo - 1].copy(), begun[todo]
            begun[todo] = a
            live, step = np.arange(len(todo)), 0
            while True:
                live = live[(a[live] != b[live]) & (size[todo[live]] > step)]
                if not len(live):
                    break
                c = own[at[todo[live]] + step]
                x, y = table.step(a[live], c), table.step(b[live], c)
                fails[todo[live]] += (y >> 31) - (x >> 31)
                a[live], b[live] = x ^ (x >> 31), y ^ (y >> 31)
                step += 1
            changed = todo[a != b]
            end[changed] = a[a != b]
            todo = later[end[later - 1] != begun[later]] if len(changed) else changed


def fold(text: str) -> str:
    """Lower-case letters; runs of anything else are one space; a space at both ends."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


class Folder:
    """``fold`` by a translation table that grows with the characters met."""

    class Table(dict):
        def __missing__(self, point: int) -> str:
            c = chr(point)
            self[point] = c if c.isalpha() else " "
            return self[point]

    def __init__(self):
        self.table = self.Table()

    def __call__(self, text: str) -> str:
        return " " + " ".join(text.lower().translate(self.table).split()) + " "


def fit(docs: DataFrame) -> Model:
    """Learn from rows with a label; see the module for the bounds."""
    rank = Window.partitionBy("lang").orderBy("over", F.xxhash64("doc_id"), "doc_id")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chars = min(CHARS_PER_LANG, TOTAL_CHARS // max(1, known.select("lang").distinct().count()))
    known = known.withColumn("over", F.length("text") > chars)
    ids = known.select("doc_id", "lang", "over", F.least(F.length("text"), F.lit(chars)).alias("n")).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= DOCS_PER_LANG)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.withColumn("before", before).filter(F.col("before") < 2 * chars).groupBy("doc_id", "lang", "over").agg(F.min("rank").alias("rank"))
    ids = ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), F.col("over").alias("long"), "rank")
    texts = known.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")) & (F.col("over") == F.col("long")))
    rows = texts.groupBy("lang", "rank", "doc_id", "over").agg(F.substring(F.min("text"), 1, chars).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["text"])):
        held = samples.setdefault(r["lang"], [])
        room = chars - sum(map(len, held))
        if r["over"] or len(r["text"]) <= room:
            held.append(r["text"][:room])
    return Model({k: " ".join(v) for k, v in samples.items()})


def predict(model: Model, texts: list[str | None], folder: Folder | None = None) -> list[tuple[str, float, list[int]]]:
    """(language, score, phrases by language) of each text. Score: the runner-up's share of the two least entropies."""
    folder = folder or Folder()
    folded = [folder(t) if isinstance(t, str) else "  " for t in texts]
    some = [i for i, t in enumerate(folded) if model.langs and not t.isspace()]
    out: list[tuple[str, float, list[int]]] = [(UND, 0.0, [])] * len(texts)
    counts = model.phrases([model.codes(folded[i]) for i in some])
    entropy = counts * np.array(model.bits)[:, None] if some else counts
    for j, i in enumerate(some):
        e = entropy[:, j]
        best = int(np.argmin(e))
        second = np.partition(e, 1)[1] if len(e) > 1 else e[best] * 3
        out[i] = (model.langs[best], float(second / (e[best] + second)), counts[:, j].tolist())
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = remainder(F.col("doc_id"), FOLDS) == HELD
    shared = spark.sparkContext.broadcast(fit(narrow.filter(~held)))

    def run(batches):
        folder = Folder()
        for rows in grouped(batches, lambda r: 40 + (len(r[2]) if isinstance(r[2], str) else 0), WORK_CHARS):
            found = predict(shared.value, [r[2] for r in rows], folder)
            out = pd.DataFrame({"doc_id": pd.array([None if pd.isna(r[0]) else int(r[0]) for r in rows], "Int64"), "held_out": [bool(r[1]) for r in rows]})
            out["lang_pred"], out["score"], out["phrases"] = [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]
            yield out

    return narrow.select("doc_id", held.alias("held_out"), "text").mapInPandas(run, SCHEMA)
