"""Numbering, sums and reachability at sizes where ranges are sampled, in several layouts."""

import pytest
from pyspark.sql import functions as F

from shotloom.operators.augment import reachable
from shotloom.operators.common import broadcast_if_bounded, dense_index, ordered_prefix
from shotloom.sources.files import load_txt_records

ROWS = 200_000


@pytest.mark.parametrize("parts", [2, 3, 4, 5, 7, 8, 200])
def test_dense_index_and_sums_with_payload(spark, parts):
    df = spark.range(ROWS, numPartitions=5).select(
        (F.col("id") * 7919 % ROWS).alias("k"), F.concat(F.lit("payload "), F.col("id")).alias("payload"))
    got = dense_index(df, [], ["k"], partitions=parts)
    row = got.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"),
                  F.max("idx").alias("hi"), F.count_if(F.col("idx") != F.col("k")).alias("wrong")).first()
    assert tuple(row) == (ROWS, ROWS, 0, ROWS - 1, 0)
    # one group holds two thirds of the rows
    grouped = df.withColumn("g", F.when(F.col("k") % 3 == 0, "a").otherwise("b"))
    sums = ordered_prefix(grouped, ["g"], ["k"], value=F.col("k"), partitions=parts)
    row = sums.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("_pos").alias("d"), F.max("_pos").alias("p"),
                                F.max("_cum").alias("c"), F.sum("k").alias("s")).collect()
    assert all(r.n == r.d == r.p + 1 and r.c == r.s for r in row)


def test_text_positions(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        got = load_txt_records(spark, str(path)).select("pos").agg(F.count("*"), F.countDistinct("pos"), F.max("pos"))
        assert tuple(got.first()) == (60_000, 60_000, 59_999)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_reachable_has_no_depth_limit(spark):
    edges = [(1, f"n{i}", f"n{i + 1}") for i in range(100)] + [(1, "n100", "n50"), (2, "a", "b"), (2, "z", "a")]
    got = reachable(spark.createDataFrame(edges, "qid long, src string, dst string"),
                    spark.createDataFrame([(1, "n0"), (2, "a")], "qid long, node string"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == {(1, f"n{i}") for i in range(101)} | {(2, "a"), (2, "b")} and got.count() == len(rows)


def test_broadcast_is_refused_by_bytes(spark):
    small = spark.createDataFrame([(1, "x"), (2, None)], "k long, t string")
    assert broadcast_if_bounded(small)[1]
    wide = spark.range(70).select("id", F.repeat(F.lit("x"), 1 << 20).alias("t"), F.array(F.lit("a")).alias("l"))
    assert not broadcast_if_bounded(wide)[1]
