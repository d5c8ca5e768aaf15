"""Connected components by alternating stars; edges stay distributed and lineage is cut after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import discard, materialize

#: Parts over which a node's neighbours are dealt.
SALTS = 64


def with_least(edges: DataFrame) -> DataFrame:
    """Add ``m``, the smallest b of each a, to rows (a, b).

    A node's rows stay dealt over SALTS parts by a hash of b: each part has its minimum, a node's at most SALTS minima meet, and
    go back to the parts. So not even a hub's rows gather in one task.
    """
    dealt = edges.withColumn("__salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = dealt.groupBy("a", "__salt").agg(F.min("b").alias("m"))
    least = parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return dealt.join(least, ["a", "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node that an edge names; the root is the smallest node of its component.

    Each half round sends a node's neighbours to the smallest one; see with_least. Self-loops, null ends and repeated edges are
    harmless; no edges give no rows. A round's table is deleted when the next one is written.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    now = materialize(now, "edges")
    before = None
    while True:
        both = with_least(now.union(now.select("b", "a")))
        large = both.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        down = large.filter(F.col("a") != F.col("b")).distinct()
        small = with_least(down).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct(), "edges")
        discard(now)
        now = new
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
