"""What grows with the log is not broadcast by the planner's guess at a stored table's size."""

from pyspark.sql import functions as F

from shotloom.operators.common import salted_join, stored
from shotloom.operators.retrieve import struct_retrieve


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_salted_side_is_never_broadcast(spark):
    """Equal values: a few kilobytes as Parquet, 32 times 50,000 rows once salted."""
    small = stored(spark.range(50_000).select((F.col("id") * 0 + 1).alias("k"), F.lit("x").alias("v")), "salted")
    big = spark.range(1000).select("id", (F.col("id") % 5).alias("k"))
    assert "BroadcastHashJoin" not in _plan(salted_join(big, small, ["k"], F.col("id")))


def test_struct_retrieve_joins_items_by_shuffle(spark):
    """The joins of items, scores and picks are shuffles; only sides counted small are broadcast."""
    items = spark.range(300).select(F.col("id").alias("qid"), F.array(F.lit("how"), F.concat(F.lit("n"), F.col("id") % 40)).alias("toks"),
                                    (F.col("id") % 7 == 0).alias("setop"), (F.col("id") % 3).alias("jc"),
                                    *[(F.col("id") % n == 0).alias(c) for n, c in enumerate("ghol", 2)])
    out = struct_retrieve(items, 3)
    assert _plan(out).count("SortMergeJoin") >= 3
    few = sorted(map(tuple, out.collect()))
    spark.conf.set("shotloom.broadcast.maxRows", "0")
    try:
        assert sorted(map(tuple, struct_retrieve(items, 3).collect())) == few
    finally:
        spark.conf.unset("shotloom.broadcast.maxRows")
