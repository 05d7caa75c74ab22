"""Near-duplicates by DartMinHash: weighted signatures, banded join, exact check, components.

A text is the bag of its five-word shingles; two texts are near-duplicates if the weighted Jaccard
similarity of the bags (sum of minima over sum of maxima of the counts) is ``SIMILARITY`` or more.

Signatures. An element of weight w owns the region [0, w) x [0, inf) of a plane of weight and rank.
Hashed darts fall on the plane at unit intensity, the same for an element wherever it occurs: the
plane is cut into cells (weights 0-1, 1-2, 2-4, ...; ranks by ``RANK_EDGES``), the number of darts in
a cell is a Poisson draw from the cell's hash, their places are hashes too. A dart counts if it is
inside the region, belongs to one of ``K`` coordinates by hash, and a coordinate keeps its dart of
least rank. Two texts keep the same dart in a coordinate with the probability of their similarity.
Ranks are explored to where about ``K (ln K + 3)`` darts are expected, and on, doubling, for the few
texts with an empty coordinate. So the cost is that of the text plus ``K ln K``, not their product.

Joining. Equal texts are one class from the start. ``BANDS`` bands of ``ROWS`` coordinates are hashed;
in each bucket all members are paired with one pivot, not with each other. The pivot is the member
whose buckets hold most documents in all, so that a large group has one pivot in most of its buckets.
Pairs whose sizes allow a similarity of t are checked exactly, and verified pairs make components.
A pair of similarity 0.8 shares a bucket with probability 0.9999.

What is left are pairs of one bucket that are in different components. All documents paired with one
pivot, or with pivots of one component, are a block (``within``). A block of few documents is compared pair by pair in one task. In a
larger one, C is the bag of the shingles that are common in a few of its members. Let O be the overlap
of two bags and |x| the size of one. A similarity of t needs O(u, v) >= t / (1 + t) (|u| + |v|), but
O(u, v) <= min(O(u, C), O(v, C)) + what u and v share beyond their counts in C. So u and v can be
similar only if min(O(u, C), O(v, C)) alone is enough, which makes both near to C, or if they share
enough excess. A member whose excess, as far as others have it too, is not enough has no partner.
The others are dealt into one block for each of their rarest excess shingles, as many as leave no
partner out, and those blocks are treated in the same way as long as they get smaller, by a tenth at
least; in one that does not, all pairs that sizes allow are compared (check_h, with a
large near group, has none: 3 large blocks, all divided at once). So a group of copies with edits of their
own costs its size, not its square, and every pair of a bucket is compared, in one component, or
proved to be below t. C may be any bag; it is taken of a sample because that changes the work only.

Defined cases: a text of fewer than five words is one shingle; texts without a word are alike only if
equal; null texts are in no class but their own; rows of one id are one document (its least text
counts); rows with a null id are left out; very long texts are bags like others; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, cut, encode, grouped, mix64, small_batches, unit
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 32
K = ROWS * BANDS
SPARE = 3.0
RANK_EDGES = np.concatenate([[0.0, 1 / 16, 1 / 4], 2.0 ** np.arange(0, 40)])
#: What is sketched at once: characters, where a row counts for its ``K (ln K + 3)`` darts as well, which take far more memory than a short text.
WORK_CHARS, DARTS_CHARS = 1_500_000, 6_000
#: A block of up to so many documents, of so many shingles in all, is compared in one task.
FEW, FEW_SHINGLES = 256, 2_000_000
#: Members that C is taken of, and the share of them that must have a shingle. A block is divided on if it is this part of the one before at most.
SAMPLED, COMMON, SHRUNK = 32, 0.3, 0.9

_POLY = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes without white space, by prefix sums of a polynomial."""
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    n = len(b)
    length = end - start
    if not len(start):
        return np.zeros(0, np.uint64)
    # Horner over the position within a word: sum (byte + 1) * POLY ** (offset in word)
    offset = np.arange(n) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [n]])))
    power = np.cumprod(np.full(int(length.max()) + 1, _POLY, np.uint64))
    inside = ~space[1:-1]
    terms = np.zeros(n, np.uint64)
    terms[inside] = (b[inside].astype(np.uint64) + np.uint64(1)) * power[offset[inside]]
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix64(total[end] - total[start] + length.astype(np.uint64) * GOLDEN)


def shingles(raw: bytes) -> np.ndarray:
    """Hashes of all shingles in order, with repeats; one for a short text, none without a word."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, np.uint64(min(len(w), SHINGLE)))
    for k in range(min(len(w), SHINGLE)):
        h = mix64(h * GOLDEN + w[k : k + n])
    return h


def bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(raw), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = np.searchsorted(b[0], a[0])
    both[both == len(b[0])] = 0
    same = b[0][both] == a[0]
    low = int(np.minimum(a[1][same], b[1][both[same]]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


class Poisson:
    """Inverse distribution functions, kept by mean."""

    def __init__(self):
        self.tables: dict[float, np.ndarray] = {}

    def draw(self, mean: float, u: np.ndarray) -> np.ndarray:
        if mean not in self.tables:
            k = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
            logs = k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
            self.tables[mean] = np.cumsum(np.exp(logs))
        return np.searchsorted(self.tables[mean], u, side="right")


def darts(owner, element, weight, reach, first_rank: int, last_rank: int, poisson: Poisson):
    """Darts inside the elements' regions in rank cells first..last, at ranks below the owner's reach.

    owner, element, weight: of each element; reach: of each owner. Gives owner, coordinate, rank, dart.
    """
    found = []
    levels = int(np.ceil(np.log2(max(1.0, float(weight.max()))))) + 1 if len(weight) else 0
    for level in range(levels):
        w_lo, w_hi = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0**level)
        in_level = weight > w_lo
        for cell in range(first_rank, last_rank + 1):
            r_lo, r_hi = RANK_EDGES[cell], RANK_EDGES[cell + 1]
            here = np.flatnonzero(in_level & (reach[owner] > r_lo))
            if not len(here):
                continue
            seed = mix64(element[here] + np.uint64((((level << 8) + cell + 1) * int(GOLDEN)) & (2**64 - 1)))
            n = poisson.draw((w_hi - w_lo) * (r_hi - r_lo), unit(seed))
            at = np.repeat(here, n)
            if not len(at):
                continue
            turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix64(np.repeat(seed, n) ^ mix64(turn.astype(np.uint64) + np.uint64(1)))
            place = mix64(dart ^ np.uint64(0x5851F42D4C957F2D))
            rank = r_lo + (r_hi - r_lo) * unit(place)
            inside = (w_lo + (w_hi - w_lo) * unit(mix64(place + GOLDEN)) < weight[at]) & (rank < reach[owner[at]])
            at, dart, rank = at[inside], dart[inside], rank[inside]
            found.append((owner[at], ((dart >> np.uint64(20)) % np.uint64(K)).astype(np.int64), rank, dart))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], poisson: Poisson | None = None) -> np.ndarray:
    """(len(bags), K) darts; rows of empty bags are 0."""
    poisson = poisson or Poisson()
    out = np.zeros(len(bags) * K, np.uint64)
    best = np.full(len(bags) * K, np.inf)
    total = np.array([float(b[1].sum()) for b in bags])
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(len(bags))
    reach[todo] = K * (np.log(K) + SPARE) / total[todo]
    while len(todo):
        owner = np.repeat(todo, [len(bags[i][0]) for i in todo])
        element = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo]).astype(np.float64)
        last = int(np.searchsorted(RANK_EDGES, reach[todo].max(), side="left")) - 1
        who, coordinate, rank, dart = darts(owner, element, weight, reach, 0, last, poisson)
        key = who * K + coordinate
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        out[key[first]] = dart[first]
        empty = ~np.isfinite(best.reshape(-1, K)[todo]).all(axis=1)
        todo = todo[empty]
        reach[todo] *= 2.0
    return out.reshape(-1, K)


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h * GOLDEN + parts[:, :, k])
    return h.view(np.int64)


def sketches(batches):
    """The rows of ``sketch`` for pandas batches of (doc_id, text, digest)."""
    poisson = Poisson()
    for rows in grouped(batches, lambda r: DARTS_CHARS + (len(r[1]) if isinstance(r[1], str) else 0), WORK_CHARS):
        bags = [bag(raw) for raw in encode(r[1] for r in rows)]
        keys = bands(signatures(bags, poisson))
        yield pd.DataFrame({
            "doc_id": [r[0] for r in rows], "digest": [r[2] for r in rows], "size": [int(b[1].sum()) for b in bags],
            "keys": [k if len(b[0]) else np.zeros(0, np.int64) for k, b in zip(keys, bags, strict=True)],
        })


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, keys): digest of the text (null for null texts), number of shingles, bucket keys (none without a word). No shuffle."""
    withed = docs.select("doc_id", "text", F.sha2(F.col("text"), 256).alias("digest"))
    return withed.mapInPandas(sketches, "doc_id long, digest string, size long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are at least that similar."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def check(batches):
        known, at = None, None
        for batch in batches:
            keep = []
            for a, b, ta, tb in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False, name=None):
                if at != b:
                    known, at = bag(tb.encode("utf-8")), b
                keep.append(similarity(bag(ta.encode("utf-8")), known) >= threshold)
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(check, "a long, b long")


def mixed_ids(hashed: DataFrame) -> DataFrame | None:
    """Ids of ``hashed`` (doc_id, digest) that have different texts; nothing if there are none."""
    kinds = hashed.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("digest", F.lit("")).alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    mixed = cut(kinds.filter("lo <> hi").select("doc_id"))
    return mixed if mixed.limit(1).count() else None


def least_texts(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """``sketched`` with the least text only of each id."""
    mixed = mixed_ids(sketched)
    if mixed is None:
        return sketched
    least = rows.join(mixed, "doc_id").groupBy("doc_id").agg(F.sha2(F.min("text"), 256).alias("least"))
    return cut(sketched.join(least, "doc_id", "left").filter("least IS NULL OR digest = least").drop("least"))


def by_text(docs: DataFrame, unit: str) -> DataFrame:
    """``docs`` with a column ``unit`` that tells an id's texts apart: the id for its least text, ids beyond the greatest for others."""
    key = F.col("doc_id").cast("long")
    hashed = docs.select(key.alias("doc_id"), F.sha2(F.col("text"), 256).alias("digest"))
    mixed = mixed_ids(hashed)
    if mixed is None:
        return docs.withColumn(unit, key)
    least = docs.select(key.alias("doc_id"), "text").join(mixed, "doc_id").groupBy("doc_id").agg(F.sha2(F.min("text"), 256).alias("least"))
    more = hashed.join(least, "doc_id").withColumn("digest", F.coalesce("digest", F.lit(""))).filter("digest <> least").select("doc_id", "digest").distinct()
    top = hashed.agg(F.max("doc_id")).first()[0]
    numbered = more.orderBy("doc_id", "digest").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], top + 1 + x[1]))
    units = cut(docs.sparkSession.createDataFrame(numbered, "__unit_doc long, __unit_digest string, __unit long"))
    same = (key == F.col("__unit_doc")) & (F.coalesce(F.sha2(F.col("text"), 256), F.lit("")) == F.col("__unit_digest"))
    return docs.join(units, same, "left").withColumn(unit, F.coalesce("__unit", key)).select(*docs.columns, unit)


def once(docs: DataFrame, unit: str) -> DataFrame:
    """``docs`` with one row of each ``unit``; rows without one stay. Only where a unit is repeated are rows moved."""
    if not docs.groupBy(unit).agg(F.count("*").alias("n")).filter(f"{unit} IS NOT NULL AND n > 1").limit(1).count():
        return docs
    return docs.filter(F.col(unit).isNotNull()).dropDuplicates([unit]).unionByName(docs.filter(F.col(unit).isNull()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), class_size."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    keep = scratch.keep
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    sketched = least_texts(rows, keep("sketched", sketch(rows)))
    # equal texts: one representative each
    owner = keep("owner", sketched.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    same = sketched.filter("digest IS NOT NULL").join(owner, "digest").select("doc_id", "rep", "size", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys"))
    same = keep("same", same)
    members = same.select("doc_id", "rep").union(sketched.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("rep"))).distinct()
    members = keep("members", members)
    # a bucket needs two members
    buckets = same.filter("doc_id = rep").select("doc_id", "size", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("key", "n")
    shared = keep("shared", shared)
    central = buckets.join(shared, "key").groupBy("doc_id", "size").agg(F.sum("n").alias("weight"), F.collect_set("key").alias("keys"))
    central = keep("central", central)
    scratch.drop("sketched", "owner", "same", "shared")
    placed = central.select(F.explode("keys").alias("key"), "doc_id", "size", "weight")
    pivots = placed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), "size")).alias("top")).select("key", (-F.col("top.minus")).alias("b"), F.col("top.size").alias("size_b"))
    pivots = keep("pivots", pivots)
    pairs = placed.select("key", F.col("doc_id").alias("a"), F.col("size").alias("size_a")).join(pivots, "key").filter("a <> b")
    star = keep("star", pairs.select("a", "b", "size_a", "size_b").distinct())
    # at scale the ids are too many for a broadcast; so it is the same plan at every size
    texts = keep("texts", rows.join(central.select("doc_id").hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    scratch.drop("central", "pivots")
    alike = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold - 1e-9)
    edges = keep("edges", verified(star.filter(alike).select("a", "b"), texts, threshold))
    labels = components(edges)
    blocks = keep("blocks0", families(star, labels))
    labels = merged(labels, within(blocks, texts, threshold, scratch))
    scratch.drop_all_but("members")
    found = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    sizes = keep("sizes", found.groupBy("class_id").agg(F.count("*").alias("class_size")))
    return found.join(sizes, "class_id").select("doc_id", "class_id", "class_size")


def families(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (block, doc, size, comp): the documents paired with a pivot, and ``comp``, the component of each; pivots of one component have one block."""
    of = lambda name, label: labels.select(F.col("id").alias(name), F.col("component").alias(label))
    placed = star.join(of("a", "comp"), "a", "left").join(of("b", "block"), "b", "left")
    return placed.select(F.coalesce("block", "b").alias("block"), F.col("a").alias("doc"), F.col("size_a").alias("size"), F.coalesce("comp", "a").alias("comp")).distinct().withColumn("parent", F.lit(None).cast("long"))


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``labels`` (id, component) with components joined by ``pairs`` (a, b) of them."""
    joined = components(pairs).select(F.col("id").alias("component"), F.col("component").alias("least"))
    known = labels.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    return known.union(joined.join(labels.select("component"), "component", "left_anti").select("component", "least"))


def within(blocks: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of components that have similar documents in one block; see the module.

    ``blocks``: block, doc, size, comp, parent (documents of the block that it comes from), with a row for each document of a block.
    """
    found, depth = None, 0
    while True:
        counts = blocks.groupBy("block").agg(F.count("*").alias("n"), F.max("parent").alias("parent"), F.sum("size").alias("total"), F.min("size").alias("smallest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("doc")).alias("who"))
        few = (F.col("n") <= FEW) & (F.col("total") <= FEW_SHINGLES)
        # blocks of the same documents are one
        stuck = ~few & F.coalesce(F.col("n") > F.lit(SHRUNK) * F.col("parent"), F.lit(False))
        one = counts.filter("lo <> hi").groupBy("n", "who", "total").agg(F.min(F.struct("block", "smallest", few.alias("few"), stuck.alias("stuck"))).alias("x"))
        open_blocks = scratch.keep(f"open{depth}", one.select("x.block", "n", "x.smallest", "x.few", "x.stuck"))
        members = scratch.keep(f"members{depth}", blocks.drop("parent").join(open_blocks, "block"))
        pairs = few_pairs(members.filter("few"), texts, threshold)
        if members.filter("stuck").limit(1).count():  # every pair that sizes allow
            u, v = (members.filter("stuck").select("block", F.col("doc").alias(x), F.col("comp").alias(f"c{x}"), F.col("size").alias(f"s{x}")) for x in ("u", "v"))
            pairs = pairs.union(tried(u.join(v, "block").filter((F.col("cu") < F.col("cv")) & (F.least("su", "sv") >= F.greatest("su", "sv") * F.lit(threshold - 1e-9))), texts, threshold))
        large = members.filter("NOT few AND NOT stuck").drop("few", "stuck")
        last = not large.limit(1).count()
        if not last:
            centres = scratch.keep(f"centres{depth}", centres_of(large, texts))
            beyond = scratch.keep(f"beyond{depth}", excesses(large, centres, texts, threshold).repartition("doc"))  # lest one task has a whole block
            pairs = pairs.union(near_centre(beyond.filter("spare < 0"), texts, threshold, scratch, depth))
            blocks = scratch.keep(f"blocks{depth + 1}", divided(beyond, scratch, depth))
        pairs = scratch.keep(f"pairs{depth}", pairs.distinct())
        found = pairs if found is None else found.union(pairs)
        scratch.drop(*(f"{name}{depth}" for name in ("open", "members", "centres", "beyond", "often", "blocks", "free", "centred")))
        if last:
            return found
        depth += 1


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Overlap of every two bags, and the size of each. The kth time that a bag has a shingle is an element of its own."""
    sizes = np.array([int(b[1].sum()) for b in bags], np.int64)
    elements = []
    for kinds, counts in bags:
        turn = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        elements.append(mix64(np.repeat(kinds, counts) + turn.astype(np.uint64) * GOLDEN))
    _, at, n = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    owner, number = np.repeat(np.arange(len(bags)), sizes), np.cumsum(n > 1) - 1
    some = n[at] > 1
    owner, column = owner[some], number[at[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    low = np.zeros((len(bags), len(bags)), np.int64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        has = np.zeros((len(bags), 4096), np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        low += (has @ has.T).astype(np.int64)
    return low, sizes


def few_pairs(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of components by comparing all documents of each block, which has few."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        comps = group["comp"].to_numpy(np.int64)
        low, sizes = overlaps([bag(t.encode("utf-8")) for t in group["text"]])
        both = np.maximum(sizes[:, None] + sizes[None, :] - low, 1)
        a, b = np.nonzero((low / both >= threshold) & (comps[:, None] < comps[None, :]))
        return pd.DataFrame(sorted(set(zip(comps[a].tolist(), comps[b].tolist(), strict=True))), columns=["a", "b"])

    withed = members.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("block", "doc", "comp", "text")
    return withed.groupBy("block").applyInPandas(compare, "a long, b long")


def tried(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of components (cu, cv) of which documents (u, v) are similar; each pair of documents is compared once."""
    one = pairs.groupBy(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).agg(F.min(F.struct("cu", "cv")).alias("c"))
    same = verified(one.select("a", "b"), texts, threshold)
    return same.join(one, ["a", "b"]).select(F.col("c.cu").alias("a"), F.col("c.cv").alias("b"))


def excess(a: tuple[np.ndarray, np.ndarray], p: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of ``a`` beyond their counts in ``p``, by how much, and the overlap of both."""
    if not len(p[0]):
        return a[0], a[1], 0
    both = np.searchsorted(p[0], a[0])
    both[both == len(p[0])] = 0
    known = np.where(p[0][both] == a[0], p[1][both], 0)
    more = np.maximum(a[1] - known, 0)
    return a[0][more > 0], more[more > 0], int(np.minimum(a[1], known).sum())


def centre(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least two of ``bags`` have, and ``COMMON`` of them, with their median count there."""
    every, counts = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    order = np.lexsort((counts, every))
    kinds, start, n = np.unique(every[order], return_index=True, return_counts=True)
    often = n >= max(2, COMMON * len(bags))
    return kinds[often], counts[order][(start + n // 2)[often]]


def centres_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(block, kinds, counts): the bag of the shingles that are common in a few members of each block, chosen by hash."""
    chance = F.pmod(F.xxhash64("block", "doc"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = members.filter(chance < F.lit(SAMPLED) / F.col("n")).join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("block", "text")

    def of_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kinds, counts = centre([bag(t.encode("utf-8")) for t in group["text"]])
        return pd.DataFrame({"block": [key[0]], "kinds": [kinds.view(np.int64)], "counts": [counts]})

    return sample.groupBy("block").applyInPandas(of_block, "block long, kinds array<long>, counts array<long>")


def excesses(members: DataFrame, centres: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """For each member of a block: its overlap with the block's centre, its excess, and ``spare``.

    ``spare``: how much of its excess a partner may lack, if all partners are as small as can be; below 0
    if a partner may lack all.
    """

    def emit(batches):
        known, at = None, None
        for batch in batches:
            out = []
            for block, doc, comp, n, smallest, text, kinds, counts in batch[["block", "doc", "comp", "n", "smallest", "text", "kinds", "counts"]].itertuples(index=False, name=None):
                if at != block:
                    none = np.zeros(0, np.int64)
                    known, at = (none.view(np.uint64), none) if kinds is None else (np.array(kinds, np.int64).view(np.uint64), np.array(counts, np.int64)), block
                own = bag(text.encode("utf-8"))
                what, more, overlap = excess(own, known)
                size = int(own[1].sum())
                need = threshold / (1 + threshold) * (size + max(smallest, threshold * size)) - overlap
                spare = max(-1, int(np.ceil(need - 1e-9)) - 1)
                if int(more.sum()) > spare:  # else nobody can be similar
                    out.append((block, doc, comp, n, size, overlap, spare, what.view(np.int64), more))
            yield pd.DataFrame(out, columns=["block", "doc", "comp", "parent", "size", "overlap", "spare", "shingles", "more"])

    withed = members.join(texts.withColumnRenamed("doc_id", "doc"), "doc").join(centres, "block", "left")
    return withed.mapInPandas(emit, "block long, doc long, comp long, parent long, size long, overlap long, spare long, shingles array<long>, more array<long>")


def divided(beyond: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """Blocks of the members that share one of their rarest excess shingles; see the module."""
    lines = beyond.select("block", "doc", "comp", "parent", "size", "spare", F.explode(F.arrays_zip("shingles", "more")).alias("x")).select("block", "doc", "comp", "parent", "size", "spare", F.col("x.shingles").alias("shingle"), F.col("x.more").alias("more"))
    often = lines.groupBy("block", "shingle").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("block", "shingle", "n")
    often = scratch.keep(f"often{depth}", often)
    # from the commonest shingle on: what stays within the member's spare is left out
    known = lines.join(often, ["block", "shingle"]).groupBy("block", "doc", "comp", "parent", "size", "spare").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "more")), False).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("keys"))

    def step(s, x):
        upto = s["sum"] + x["more"]
        return F.struct(upto.alias("sum"), F.when(upto > F.col("spare"), F.concat(s["keys"], F.array(x["shingle"]))).otherwise(s["keys"]).alias("keys"))

    keyed = known.select("block", "doc", "comp", "parent", "size", F.explode(F.aggregate("xs", start, step, lambda s: s["keys"])).alias("shingle"))
    return keyed.select(F.xxhash64("block", "shingle").alias("block"), "doc", "size", "comp", "parent")


def near_centre(free: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch, depth: int) -> DataFrame:
    """Pairs of components by members (block, doc, comp, size, overlap) that may be similar by their overlaps with the centre alone.

    All are compared with that of the largest overlap first, and then those that were not joined by it.
    """
    free = free.select("block", "doc", "comp", "size", "overlap")
    top = free.groupBy("block").agg(F.max(F.struct("overlap", (-F.col("doc")).alias("minus"), "comp", "size")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    ready = free.join(top, "block").select("block", F.col("doc").alias("u"), F.col("comp").alias("cu"), F.col("size").alias("su"), F.col("overlap").alias("ou"), (-F.col("top.minus")).alias("v"), F.col("top.comp").alias("cv"))
    free = scratch.keep(f"free{depth}", ready)
    first = scratch.keep(f"centred{depth}", tried(free.filter("cu <> cv"), texts, threshold).distinct())
    joined = first.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    left = free.filter("cu <> cv").withColumns({"x": F.greatest("cu", "cv"), "y": F.least("cu", "cv")}).join(joined, ["x", "y"], "left_anti").select("block", "u", "cu", "su", "ou")
    other = free.filter("u <> v").select("block", F.col("u").alias("v"), F.col("cu").alias("cv"), F.col("su").alias("sv"), F.col("ou").alias("ov"))
    enough = F.least("ou", "ov") >= F.lit(threshold / (1 + threshold)) * (F.col("su") + F.col("sv")) - F.lit(1e-9)
    return first.union(tried(left.join(other, "block").filter((F.col("cu") != F.col("cv")) & enough).select("u", "v", "cu", "cv"), texts, threshold))
