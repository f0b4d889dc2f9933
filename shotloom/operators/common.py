"""Join and ranking building blocks with explicit size checks and skew handling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotloom.session import (CONF_BROADCAST_BYTES, CONF_BROADCAST_ROWS, CONF_SALTS, DEFAULT_BROADCAST_BYTES,
                              DEFAULT_BROADCAST_ROWS, DEFAULT_SALTS, checkpoint_dir, conf_int)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: contents of strings and arrays, eight for anything of fixed width."""
    def of(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(col), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType):
            fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
            inner = (F.size(col) * 8 if fixed else
                     F.aggregate(col, F.lit(0), lambda n, x: n + of(x, kind.elementType).cast("int")))
            return F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)) + 8
        if isinstance(kind, T.StructType):
            return sum((of(col[f.name], f.dataType) for f in kind.fields), F.lit(8))
        if isinstance(kind, T.MapType):
            return of(F.map_keys(col), T.ArrayType(kind.keyType)) + of(F.map_values(col), T.ArrayType(kind.valueType))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")


def broadcast_if_bounded(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only after counting its rows and bytes: returns (df, was_broadcast).

    The count runs on the small side only; above either bound the caller must use a
    shuffle join instead (see :func:`join_small_side`).
    """
    spark = df.sparkSession
    limit = max_rows if max_rows is not None else conf_int(spark, CONF_BROADCAST_ROWS, DEFAULT_BROADCAST_ROWS)
    size = df.agg(F.count("*").alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    if size.n <= limit and (size.b or 0) <= conf_int(spark, CONF_BROADCAST_BYTES, DEFAULT_BROADCAST_BYTES):
        return F.broadcast(df), True
    return df, False


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_block: int,
                right_block: int) -> tuple[GroupedData, GroupedData]:
    """Both sides dealt into blocks of about the given rows and grouped by (left block, right block).

    Every left row meets every right row in exactly one group, whose size does not
    grow with the data; for work that compares a stated set with all rows.
    """
    n_left, n_right = max(1, -(-left.count() // left_block)), max(1, -(-right.count() // right_block))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_left, n_right)]
    dealt_left = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.lit(n_left)).cast("int")).withColumn("_rb", every[1])
    dealt_right = (right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int"))
                   .withColumn("_lb", every[0]))
    return dealt_left.groupBy("_lb", "_rb"), dealt_right.groupBy("_lb", "_rb")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is never broadcast: of a stored table the planner knows only the compressed size."""
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt_of: Column,
                salts: int | None = None, how: str = "inner") -> DataFrame:
    """Shuffle equi-join that spreads a hot key of ``big`` over ``salts`` tasks.

    ``salt_of`` is a column of ``big`` that varies within a key (e.g. a row id);
    every row of ``small`` is replicated once per salt.
    """
    n = salts or conf_int(big.sparkSession, CONF_SALTS, DEFAULT_SALTS)
    b = big.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(n)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return b.join(shuffled(s), on + ["_salt"], how).drop("_salt")


def join_small_side(big: DataFrame, small: DataFrame, on: list[str], salt_of: Column,
                    how: str = "inner", max_rows: int | None = None) -> DataFrame:
    """Broadcast-hash join when ``small`` is provably small, else a salted shuffle join."""
    s, ok = broadcast_if_bounded(small, max_rows)
    if ok:
        return big.join(s, on, how)
    return salted_join(big, small, on, salt_of, how=how)


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per ``part`` under ``order``.

    ``row_number() <= k`` plans as a partial WindowGroupLimit before the shuffle,
    so at most k rows per key and map task cross the network, even for a hot key.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the rows once and keeps
    column pruning; a lost executor costs nothing that was written. With ``by``, a
    column of few values, each value gets its own folder, and a filter on it reads no other.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ordered_prefix(df: DataFrame, group: list[str], order: list[str], value: Column | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Add ``_pos`` (0-based position) and, with ``value``, ``_cum`` (inclusive running sum)
    per ``group`` under ``order``, without sending a whole group to one task.

    The rows are range-partitioned on (group, order) and written once with the
    number of their range, so a hot group spans many ranges and every later step
    reads the same layout. Each range numbers and sums its own rows, and a group
    that continues from earlier ranges adds their totals. Only the first group of
    each range can continue, so the offset table has at most one row per range and
    its broadcast is bounded by the partition count. Group keys must be non-null.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    parted = df.repartitionByRange(n, *group, *order).withColumn("_task", F.spark_partition_id())
    if value is not None:
        parted = parted.withColumn("_value", value)
    parted = stored(parted, "ranges")
    local = Window.partitionBy(*group, "_task").orderBy(*order)
    out = parted.withColumn("_pos", F.row_number().over(local) - 1)
    aggs = [F.count("*").alias("_n")]
    if value is not None:
        running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("_cum", F.sum("_value").over(running)).drop("_value")
        aggs.append(F.sum("_value").alias("_s"))
    totals = parted.groupBy(*group, "_task").agg(*aggs)
    prior = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_opos", F.sum("_n").over(prior))
    if value is not None:
        offsets = offsets.withColumn("_ocum", F.sum("_s").over(prior))
    offsets = offsets.filter(F.col("_opos").isNotNull()).drop("_n", "_s")
    out = out.join(F.broadcast(offsets), group + ["_task"], "left")
    out = out.withColumn("_pos", (F.col("_pos") + F.coalesce(F.col("_opos"), F.lit(0))).cast("bigint"))
    if value is not None:
        out = out.withColumn("_cum", F.col("_cum") + F.coalesce(F.col("_ocum"), F.lit(0)))
        out = out.drop("_ocum")
    return out.drop("_task", "_opos")


def dense_index(df: DataFrame, group: list[str], order: list[str], out: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """0-based dense position per ``group`` under ``order`` (distributed ``zipWithIndex``)."""
    if not group:
        d = df.withColumn("_g", F.lit(0))
        return ordered_prefix(d, ["_g"], order, partitions=partitions) \
            .withColumnRenamed("_pos", out).drop("_g")
    return ordered_prefix(df, group, order, partitions=partitions).withColumnRenamed("_pos", out)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a small input over the cluster before CPU-heavy row work.

    Only when the input has fewer partitions than the default parallelism (a
    single small file); large inputs are already split by the file scan and are
    returned unchanged, so no shuffle is added at scale.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
