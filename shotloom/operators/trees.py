"""Ordered labelled trees and pq-gram profiles (R9-R12), as joins and windows.

Nodes are rows (tree_id, node_id, parent_id, sib_a, sib_b, label); children are
ordered by (sib_a, sib_b). The profile (p=2, q=3) of a tree is the bag of
5-tuples (grandparent, parent, three-sibling window) over every node with
``*`` padding, and one (parent, leaf, *, *, *) tuple per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "\u001f"  # unit separator between gram labels


def turn_trees(turns: DataFrame) -> DataFrame:
    """One tree per conversation turn: root = role, children = the turn's non-empty lines."""
    tid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("tree_id")
    root = turns.select(tid, F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
                        F.lit(0).cast("bigint").alias("sib_a"), F.lit(0).cast("bigint").alias("sib_b"),
                        F.col("role").alias("label"))
    lines = turns.select(tid, F.posexplode_outer(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
                         .alias("pos", "line")).filter(F.col("line").isNotNull())
    lines = lines.filter(F.length(F.trim(F.col("line"))) > 0).select(
        "tree_id", (F.col("pos") + 1).cast("string").alias("node_id"), F.lit("0").alias("parent_id"),
        F.col("pos").cast("bigint").alias("sib_a"), F.lit(0).cast("bigint").alias("sib_b"),
        F.trim(F.col("line")).alias("label"))
    return root.unionByName(lines)


def tree_split(nodes: DataFrame, delimiter: str) -> DataFrame:
    """Split every label on ``delimiter`` into consecutive sibling nodes.

    The first part inherits the node's children; a root that splits into several
    parts is placed under a new ``*`` root.
    """
    pattern = "\\Q" + delimiter + "\\E"
    parts = nodes.select("*", F.posexplode(F.split(F.col("label"), pattern, -1)).alias("k", "part"))
    parts = parts.withColumn("n_parts", F.count("*").over(Window.partitionBy("tree_id", "node_id")))
    is_root = F.col("parent_id").isNull()
    new_parent = (F.when(is_root & (F.col("n_parts") > 1), F.lit("r"))
                   .when(is_root, F.lit(None).cast("string"))
                   .otherwise(F.concat(F.col("parent_id"), F.lit(".0"))))
    out = parts.select(
        "tree_id", F.concat(F.col("node_id"), F.lit("."), F.col("k").cast("string")).alias("node_id"),
        new_parent.alias("parent_id"),
        F.when(is_root, F.col("k")).otherwise(F.col("sib_a")).cast("bigint").alias("sib_a"),
        F.when(is_root, F.lit(0)).otherwise(F.col("k")).cast("bigint").alias("sib_b"),
        F.col("part").alias("label"))
    new_roots = (nodes.filter(F.col("parent_id").isNull() & (F.size(F.split(F.col("label"), pattern, -1)) > 1))
                      .select("tree_id", F.lit("r").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
                              F.lit(0).cast("bigint").alias("sib_a"), F.lit(0).cast("bigint").alias("sib_b"),
                              F.lit("*").alias("label")))
    return out.unionByName(new_roots)


def _gram(*cols: Column) -> Column:
    return F.concat_ws(SEP, *cols)


def pqgram_profile(nodes: DataFrame) -> DataFrame:
    """(tree_id, gram, mult) bag of pq-grams with p = 2, q = 3."""
    star = F.lit("*")
    par = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("label").alias("plabel"),
                       F.col("parent_id").alias("gparent_id"))
    gp = nodes.select("tree_id", F.col("node_id").alias("gparent_id"), F.col("label").alias("gplabel"))
    kids = (nodes.filter(F.col("parent_id").isNotNull()).join(par, ["tree_id", "parent_id"])
                 .join(gp, ["tree_id", "gparent_id"], "left"))
    w = Window.partitionBy("tree_id", "parent_id").orderBy("sib_a", "sib_b")
    kids = (kids.withColumn("l1", F.lag("label", 1).over(w)).withColumn("l2", F.lag("label", 2).over(w))
                .withColumn("ci", F.row_number().over(w))
                .withColumn("n", F.count("*").over(Window.partitionBy("tree_id", "parent_id"))))
    anc = F.coalesce(F.col("gplabel"), star)
    main = kids.select("tree_id", _gram(anc, F.col("plabel"), F.coalesce(F.col("l2"), star),
                                        F.coalesce(F.col("l1"), star), F.col("label")).alias("gram"))
    last = kids.filter(F.col("ci") == F.col("n"))
    tail1 = last.select("tree_id", _gram(anc, F.col("plabel"), F.coalesce(F.col("l1"), star),
                                         F.col("label"), star).alias("gram"))
    tail2 = last.select("tree_id", _gram(anc, F.col("plabel"), F.col("label"), star, star).alias("gram"))
    has_kids = nodes.filter(F.col("parent_id").isNotNull()).select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = nodes.join(has_kids, ["tree_id", "node_id"], "left_anti")
    leaves = leaves.join(par.select("tree_id", F.col("parent_id"), F.col("plabel").alias("up")),
                         ["tree_id", "parent_id"], "left")
    leaf = leaves.select("tree_id", _gram(F.coalesce(F.col("up"), star), F.col("label"), star, star, star).alias("gram"))
    allg = main.unionByName(tail1).unionByName(tail2).unionByName(leaf)
    return allg.groupBy("tree_id", "gram").agg(F.count("*").cast("bigint").alias("mult"))


def pqgram_compare(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """R10 + R11 for (tree_a, tree_b) pairs: bag-intersection distance and profile equality.

    distance = 1 - 2 |A n B| / (|A| + |B|) with |A n B| = sum of min multiplicities;
    equal = same size and every gram of A occurs in B.
    """
    size = profile.groupBy("tree_id").agg(F.sum("mult").cast("bigint").alias("n"))
    pa = profile.select(F.col("tree_id").alias("tree_a"), "gram", F.col("mult").alias("ma"))
    pb = profile.select(F.col("tree_id").alias("tree_b"), "gram", F.col("mult").alias("mb"))
    j = pairs.select("tree_a", "tree_b").join(pa, "tree_a").join(pb, ["tree_b", "gram"], "left")
    agg = j.groupBy("tree_a", "tree_b").agg(
        F.sum(F.least(F.col("ma"), F.coalesce(F.col("mb"), F.lit(0)))).cast("bigint").alias("inter"),
        F.sum(F.when(F.col("mb").isNull(), 1).otherwise(0)).cast("bigint").alias("missing"))
    out = (pairs.join(agg, ["tree_a", "tree_b"], "left")
                .join(size.select(F.col("tree_id").alias("tree_a"), F.col("n").alias("n_a")), "tree_a", "left")
                .join(size.select(F.col("tree_id").alias("tree_b"), F.col("n").alias("n_b")), "tree_b", "left"))
    na, nb = F.coalesce(F.col("n_a"), F.lit(0)), F.coalesce(F.col("n_b"), F.lit(0))
    inter = F.coalesce(F.col("inter"), F.lit(0))
    dist = F.when(na + nb == 0, F.lit(0.0)).otherwise(1.0 - 2.0 * inter / (na + nb))
    equal = (na == nb) & (F.coalesce(F.col("missing"), F.lit(0)) == 0)
    return out.select("tree_a", "tree_b", na.alias("n_a"), nb.alias("n_b"), inter.alias("inter"),
                      F.round(dist, 6).alias("distance"), equal.alias("equal"))
