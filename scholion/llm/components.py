"""Connected components by minimum labels, for edge tables that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b, both long or both string); the component is its least id.

    Each round an id takes the least label among its neighbours' and then that label's own label, so
    a chain is halved. A round's labels are written to the shared folder and those before deleted. The
    number of rounds grows with the logarithm of the longest path; a star takes one, and a look that
    nothing is left to do.
    """
    scratch = Scratch(edges.sparkSession, "components")
    one = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = scratch.keep("edges", one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.keep("labels0", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "least").alias("next"))
        lower = scratch.keep(f"lower{turn}", lower)
        if not lower.filter("label <> next").limit(1).count():
            scratch.drop("edges", f"lower{turn}")
            return labels.withColumnRenamed("label", "component")
        # what an id's old label may now point to: the least label that any id with that label met
        root = scratch.keep(f"root{turn}", lower.groupBy("label").agg(F.min("next").alias("root")))
        hop = lower.join(root, "label").select("id", F.least("next", "root").alias("next"))
        jump = hop.join(hop.select(F.col("id").alias("next"), F.col("next").alias("far")), "next", "left")
        labels = scratch.keep(f"labels{turn + 1}", jump.select("id", F.least("next", F.coalesce("far", "next")).alias("label")))
        scratch.drop(f"labels{turn}", f"lower{turn}", f"root{turn}")
        turn += 1
