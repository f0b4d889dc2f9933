"""Connected components of an edge table by hooking to smaller neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every vertex of ``edges(a, b)``; the root is the smallest vertex reachable.

    Each round every vertex hooks to its smallest neighbour, chains are shortened
    by pointer jumping, and edges inside one tree disappear. A round costs a few
    joins over what is left, and a star (the usual shape here) needs one.
    """
    live = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .distinct(), "cc-edges")
    ids = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
    labels = stored(ids.withColumn("root", F.col("id")), "cc-labels")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("p"))
                      .select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "cc-hook")
        jumped = hook
        for _ in range(2):
            up = jumped.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = jumped.join(up, "p").select("v", F.col("q").alias("p"))
        jumped = stored(jumped, "cc-jump")
        new_labels = stored(
            labels.join(jumped.withColumnRenamed("v", "root"), "root", "left")
            .select("id", F.coalesce("p", "root").alias("root")), "cc-labels")
        ja, jb = (jumped.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        new_live = stored(
            live.join(ja, "a").join(jb, "b").filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        for old in (live, labels, hook, jumped):
            discard(old)
        live, labels = new_live, new_labels
    return labels
