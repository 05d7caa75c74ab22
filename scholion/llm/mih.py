"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for the sign of each component, in a long, or in an array of longs where
a vector has more than 64 components. A code is cut into segments; an index has
a row for each segment of each different code. A query looks up, for every segment, the values at
Hamming distance 0 from its own, then 1, and so on. If two codes differ in at most
``S * (r + 1) - 1`` of all bits, one of their S segments differs in at most r bits; so once the radius
r is done and the kth least verified distance is within that bound, nothing nearer can be missed and
the query is finished. The others go on with the next radius. Where a radius has more than ``PROBES``
values, looking them up costs more than it saves, and the queries left are compared with all codes not
yet found, in blocks.

A segment has about as many bits as the number of codes has, so a value has few codes. A code that is
found in several segments counts where it is nearest, in the first such segment: so each pair of query
and code is made once over all radii, and what was found before is not compared again.

Equal codes are one row of the index, with their k + 1 least ids (ties go to the lesser id, so no
other can be in an answer), and equal query codes are searched once. So a vector that a third of the
rows share costs one row.

Defined cases: a null or empty vector has no code, is not found and gets no answer; null components
count as not positive; rows of one id are one vector (its least code counts), null ids are left out;
fewer than k others: as many as there are; a query is not its own neighbour; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS = 64
K = 10
#: Bits of a segment, at least and at most.
WIDTHS = (8, 32)
WIDTH = 16
PROBES = 1 << 13
#: Codes in a block.
BLOCK_CODES = 20_000


def pieces(bits: int, width: int) -> list[tuple[int, int]]:
    """Where the segments of a code begin and end: at most ``width`` bits each, and about equal."""
    n = max(BITS, bits)
    count = -(-n // width)
    return [(n * s // count, n * (s + 1) // count) for s in range(count)]


def words(bits: int, width: int) -> int:
    return -(-len(pieces(bits, width)) // (BITS // width))


def word(code: Column, at: int, bits: int, width: int) -> Column:
    """The long of a code that holds the segments from ``at * (BITS // width)`` on."""
    return code if words(bits, width) == 1 else code[at]


def sign_code(vector: Column, bits: int = BITS, width: int = WIDTH) -> Column:
    """Signs of up to ``bits`` components, each segment in ``width`` bits of a long; null for null or empty vectors."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    slots, longs = BITS // width, []
    for s, (a, b) in enumerate(pieces(bits, width)):
        signs = F.transform(F.slice(vector, a + 1, b - a), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(zero))
        part = F.shiftleft(F.aggregate(signs, zero, lambda x, y: x.bitwiseOR(y)), s % slots * width)
        if s % slots:
            longs[-1] = longs[-1].bitwiseOR(part)
        else:
            longs.append(part)
    return F.when(F.size(vector) > 0, longs[0] if len(longs) == 1 else F.array(*longs))


def masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with ``radius`` of them set."""
    return [sum(1 << i for i in chosen) for chosen in combinations(range(width), radius)]


def segment_keys(code: Column, width: int, bits: int = BITS) -> list[Column]:
    """One long for each segment: the segment's number above its value."""
    low, slots = F.lit((1 << width) - 1).cast("long"), BITS // width
    return [F.shiftrightunsigned(word(code, s // slots, bits, width), s % slots * width).bitwiseAND(low).bitwiseOR(F.lit(s << width).cast("long")) for s in range(len(pieces(bits, width)))]


def distance(a: str, b: str, bits: int = BITS, width: int = WIDTH) -> Column:
    apart = [F.bit_count(word(F.col(a), w, bits, width).bitwiseXOR(word(F.col(b), w, bits, width))) for w in range(words(bits, width))]
    return sum(apart[1:], apart[0])


def width_for(codes: int) -> int:
    """Bits of a segment for so many codes."""
    return min(WIDTHS[1], max(WIDTHS[0], round(math.log2(max(2, codes)))))


def apart(bits: int, width: int) -> Column:
    """Distances of ``query`` and ``code`` in each segment."""
    low, slots = F.lit((1 << width) - 1).cast("long"), BITS // width
    both = [word(F.col("query"), w, bits, width).bitwiseXOR(word(F.col("code"), w, bits, width)) for w in range(words(bits, width))]
    return F.array(*[F.bit_count(F.shiftrightunsigned(both[s // slots], s % slots * width).bitwiseAND(low)) for s in range(len(pieces(bits, width)))])


def search(codes: DataFrame, queries: DataFrame, k: int = K, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """``codes`` and ``queries``: (id long, code by ``sign_code`` of the same ``bits`` and ``width``). Gives query_id, rank, neighbor_id, distance."""
    segments, need = len(pieces(bits, width)), k + 1
    scratch = Scratch(codes.sparkSession, "mih")
    keep = scratch.keep
    one = codes.filter("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"))
    owners = keep("owners", least_ids(one, need))
    index = keep("index", owners.select("code", "n", F.explode(F.array(*segment_keys(F.col("code"), width, bits))).alias("key")))
    asked = keep("asked", queries.filter("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("query")))
    active = keep("active", asked.select("query", F.lit(None).cast("int").alias("bound")).distinct())
    found = finished = None
    for radius in range(width + 1):
        last = radius == width or math.comb(width, radius) > PROBES
        if last:
            many = max(64, owners.count() // BLOCK_CODES)
            blocks = active.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
            hits = blocks.join(owners.select("code", "n", F.pmod(F.xxhash64("code"), F.lit(many)).cast("int").alias("block")), "block")
            first = F.array_min("by") >= radius
        else:
            flips = F.explode(F.lit(masks(width, radius)).cast("array<long>"))
            probes = active.select("query", "bound", F.explode(F.array(*segment_keys(F.col("query"), width, bits))).alias("own")).select("query", "bound", "own", flips.alias("flip"))
            # the plan's estimate does not count the flips, so it would take the probes for small and broadcast them
            hits = probes.select("query", "bound", F.col("own").bitwiseXOR(F.col("flip")).alias("key")).hint("merge").join(index, "key")
            first = (F.array_min("by") == radius) & (F.array_position("by", F.lit(radius)) - 1 == F.shiftright("key", width))
        near = hits.withColumn("d", distance("query", "code", bits, width)).filter(F.col("bound").isNull() | (F.col("d") <= F.col("bound")))
        by = near.withColumn("by", apart(bits, width))
        new = by.filter(first).select("query", "code", "n", "d")
        hits = keep(f"hits{radius}", new if found is None else new.union(found.join(active.select("query"), "query", "left_semi")))
        # the distance within which the ids needed have been seen; null if there are too few
        by_distance = hits.groupBy("query", "d").agg(F.sum("n").alias("n"))
        running = by_distance.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy("d")))
        bound = running.filter(F.col("upto") >= need).groupBy("query").agg(F.min("d").alias("bound"))
        done = (F.col("bound") <= segments * (radius + 1) - 1) | F.lit(last)
        state = keep(f"state{radius}", active.select("query").join(bound, "query", "left").select("query", "bound", F.coalesce(done, F.lit(False)).alias("done")))
        kept = keep(f"kept{radius}", hits.join(state, "query").filter(F.col("bound").isNull() | (F.col("d") <= F.col("bound"))).select("query", "code", "n", "d", "done"))
        scratch.drop(f"hits{radius}", *([f"state{radius - 1}"] if radius else ["active"]))
        ended = kept.filter("done").select("query", "code", "n", "d")
        finished = ended if finished is None else finished.union(ended)
        found = kept.filter("NOT done").select("query", "code", "n", "d")
        active = state.filter("NOT done").select("query", "bound")
        if not active.limit(1).count():
            break
    scratch.drop_all_but("owners", "asked", *(f"kept{k}" for k in range(width + 1)))
    ids = finished.join(owners.select("code", "ids"), "code").select("query", "d", F.explode("ids").alias("id"))
    first = ids.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).filter(F.col("at") <= need)
    lists = first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    answers = asked.join(lists, "query").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.d").cast("int").alias("distance")
    )


def least_ids(one: DataFrame, need: int) -> DataFrame:
    """(code, n, ids): of each code its ``need`` least ids, in order. Sums of ids of one code are made before they meet."""
    few = one.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["code", "part"], ["code"]):
        at = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        few = few.withColumn("at", at).filter(F.col("at") <= need).drop("at")
    return few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("code", F.size("ids").alias("n"), "ids")


def top_k(vectors: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Search for every row whose id is divisible by ``every`` among all rows."""
    about = vectors.agg(F.max(F.size(vector_col)), F.count("*")).first()
    bits, width = max(BITS, about[0] or 0), width_for(about[1])
    scratch = Scratch(vectors.sparkSession, "codes")
    codes = scratch.keep("codes", vectors.select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col), bits, width).alias("code")))
    found = search(codes, codes.filter(F.col("id") % every == 0), k, width, bits)
    scratch.drop("codes")
    return found


SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_sum([CASE WHEN (q.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END FOR i IN range(1, len(q.embedding) + 1)]) AS distance
  FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""
