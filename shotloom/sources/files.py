"""File sources and sinks (S1-S4, S8): JSON arrays, JSON Lines, positional text, DDL scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from shotloom.operators.common import dense_index, join_small_side, stored


def load_json_records(spark: SparkSession, path: str, schema: Ty.StructType | str | None = None) -> DataFrame:
    """A JSON array file (or folder of them) as rows; pass ``schema`` to skip inference."""
    r = spark.read.option("multiLine", "true")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def load_jsonl(spark: SparkSession, path: str, schema: Ty.StructType | str | None = None) -> DataFrame:
    """JSON Lines."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def save_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """S3: JSON Lines, optionally partitioned (e.g. by split and selector)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, value)``: the lines of a file or folder with their places, in order of file name and line.

    No line is sorted or shuffled. A first pass over the files counts the lines of each
    read block and notes the block's first row in its task; the blocks' counts, summed in
    order of file and block start, are the offsets (one row for each block of some
    megabytes). The second pass reads a line's row number in its task and adds its block's
    offset. Where Spark cuts the files into blocks does not matter.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # without the task's number
    lines = spark.read.text(path).select(
        F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), row.alias("_row"), "value")
    blocks = stored(lines.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("_first")), "line-blocks")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = blocks.groupBy("_file").agg(F.sum("n").alias("n")).select("_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_lead"))
    offsets = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_upto")).join(files, "_file")
    offsets = offsets.select("_file", "_block", (F.col("_lead") + F.col("_upto") - F.col("_first")).alias("_shift"))
    placed = join_small_side(lines, offsets, ["_file", "_block"], F.col("_row"))
    return placed.select((F.col("_row") + F.col("_shift")).cast("bigint").alias("pos"), "value")


def load_txt_records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) with lines stripped; position is significant (it is the row index).

    A trailing newline does not produce an extra row, as with ``readlines``.
    """
    return numbered_lines(spark, path).select("pos", F.regexp_replace(F.col("value"), r"^\s+|\s+$", "").alias("line"))


def load_splits(spark: SparkSession, paths: dict[str, str | None], schema: Ty.StructType | str) -> DataFrame:
    """Every split's JSON Lines as ``(split, idx, *fields)``; ``idx`` is the line's place in its split.

    A split without a path is skipped. A path that does not exist is an error that names
    the split, raised before anything is read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    given = {split: path for split, path in paths.items() if path is not None}
    for split, path in given.items():
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(conf).exists(where):
            raise FileNotFoundError(f"split {split!r}: no file or folder {path}")
    kind = Ty.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = None
    for split, path in given.items():
        part = numbered_lines(spark, path).select(F.lit(split).alias("split"), F.col("pos").alias("idx"),
                                                  F.from_json("value", kind).alias("record")).select("split", "idx", "record.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], Ty.StructType([Ty.StructField("split", Ty.StringType()),
                                                        Ty.StructField("idx", Ty.LongType()), *kind.fields]))
    return out


def extract_create_statements(scripts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """S8 (X17 fixed): every ``CREATE TABLE ... ;`` statement of each script, in order.

    A statement starts on a line whose stripped upper-case form starts with
    ``CREATE TABLE`` and ends on the first line (possibly the same) with ``;``.
    Statement id = running count of starts; lines after the end are dropped.
    """
    lines = scripts.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    strip = F.regexp_replace(F.col("line"), r"^\s+|\s+$", "")
    lines = lines.withColumn("is_start", F.upper(strip).startswith("CREATE TABLE").cast("int"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("sid", F.sum("is_start").over(w)).filter(F.col("sid") > 0)
    lines = lines.withColumn("is_end", F.col("line").contains(";"))
    ws = Window.partitionBy(key, "sid")
    lines = lines.withColumn("end_pos", F.min(F.when(F.col("is_end"), F.col("pos"))).over(ws))
    lines = lines.filter(F.col("end_pos").isNotNull() & (F.col("pos") <= F.col("end_pos")))
    st = lines.groupBy(key, "sid").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return st.select(key, (F.col("sid") - 1).cast("bigint").alias("stmt_idx"),
                     F.regexp_replace(body, r"^\s+|\s+$", "").alias("statement"))


def union_pool(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Concatenate several training files in order and renumber ``idx`` densely."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("file_ord", F.lit(i).cast("bigint"))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return dense_index(out, [], ["file_ord", id_col], out="idx")
