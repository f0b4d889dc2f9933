"""Stores that jobs write once and read many times: embeddings (S9) and the content index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.operators.common import join_small_side
from shotloom.operators.content import table_index

EMBEDDINGS = "id bigint, db_id string, vec array<float>"
CONTENT = "column_name string, value string, value_type string, key string, db_id string, table_name string"
MANIFEST = "db_id string, table_name string, fingerprint string"
#: Literal keys that are pushed into the scan of a stored index; more of them are joined.
PUSHED_KEYS = 1000


def encode_pool(pool: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "idx",
                text_col: str = "question", db_col: str = "db_id", batch: int = 32) -> DataFrame:
    """Vectors of a whole pool by a caller's encoder, as (id, db_id, vec).

    ``encoder`` builds the model once per task and returns a function from a list of
    texts to a matrix; texts are passed ``batch`` at a time, null as empty.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for f in frames:
            encode = encode or encoder()
            texts = f["text"].fillna("").tolist()
            parts = [np.asarray(encode(texts[i:i + batch]), np.float32) for i in range(0, len(texts), batch)]
            yield pd.DataFrame({"id": f["id"], "db_id": f["db_id"], "vec": [row.tolist() for p in parts for row in p]})

    rows = pool.select(F.col(id_col).cast("bigint").alias("id"), F.col(db_col).cast("string").alias("db_id"),
                       F.col(text_col).alias("text"))
    return rows.mapInPandas(run, EMBEDDINGS)


def save_embeddings(vectors: DataFrame, path: str) -> None:
    """(id, db_id, vec) as Parquet, one folder for each database."""
    vectors.select("id", "db_id", F.col("vec").cast("array<float>")).write.mode("overwrite") \
        .partitionBy("db_id").parquet(path)


def load_embeddings(spark: SparkSession, path: str, db_ids: list[str] | None = None) -> DataFrame:
    """The stored vectors, of some databases only (their folders) if ``db_ids`` is given."""
    df = spark.read.schema(EMBEDDINGS).parquet(path)
    return df if db_ids is None else df.filter(F.col("db_id").isin(db_ids))


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's files (name, length, time of change) and schema; their contents are not read."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        for f in path.getFileSystem(conf).listStatus(path):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    used = set(df.inputFiles())
    lines = [f"{name}|{size}|{time}" for name, size, time in sorted(found)
             if name in used or name.replace("file:/", "file:///") in used]
    return hashlib.sha256("\n".join([df.schema.json(), *lines]).encode()).hexdigest()


def update_content_index(spark: SparkSession, path: str, tables: list[tuple[str, str, DataFrame]]) -> list[tuple[str, str]]:
    """Bring the stored index up to date with ``tables`` (database, table, rows); the tables that were scanned.

    A table whose files are those of the last update keeps its part of the index and is
    not read. The others are indexed in one scan each, and only their folders
    (db_id, table_name) are replaced; folders of tables that are gone or have become
    empty are removed. The manifest is written last: an update that dies before is
    simply done again. Values carry a Bloom filter on their look-up key.
    """
    manifest = f"{path}/_fingerprints"  # Spark's readers skip names that start with an underscore
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    old = {}
    if fs.exists(jvm.org.apache.hadoop.fs.Path(manifest)):
        old = {(r.db_id, r.table_name): r.fingerprint for r in spark.read.schema(MANIFEST).json(manifest).collect()}
    now = {(db, t): fingerprint(df) for db, t, df in tables}
    changed = [(db, t, df) for db, t, df in tables if old.get((db, t)) != now[db, t]]
    for key in sorted((old.keys() - now.keys()) | {(db, t) for db, t, _ in changed}):
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"db_id={key[0]}/table_name={key[1]}"), True)
    for db, t, df in changed:  # one job a table, so that one table's files fill its folder alone
        index = table_index(df, db, t)
        if index is not None:
            save_content_index(index, path)
    rows = spark.createDataFrame([(db, t, f) for (db, t), f in now.items()], MANIFEST)
    rows.coalesce(1).write.mode("overwrite").json(manifest)
    return [(db, t) for db, t, _ in changed]


def save_content_index(index: DataFrame, path: str) -> None:
    """An index as Parquet, one folder for each database and table; folders that ``index`` doesn't touch stay."""
    key = F.lower(F.trim(F.col("value")))
    (index.select("column_name", "value", "value_type", key.alias("key"), "db_id", "table_name")
     .sortWithinPartitions("db_id", "table_name", "key").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#key", "true")
     .partitionBy("db_id", "table_name").parquet(path))


def load_content_index(spark: SparkSession, path: str, db_ids: list[str] | None = None,
                       keys: DataFrame | None = None) -> DataFrame:
    """The stored index with the columns of :func:`shotloom.operators.content.content_index`.

    ``db_ids`` opens those folders only. With ``keys`` (a column ``_key``), only values with
    such a key come back: a few keys are pushed into the scan, whose row groups are then
    skipped by statistics and Bloom filter; many are joined.
    """
    df = spark.read.schema(CONTENT).parquet(path)
    if db_ids is not None:
        df = df.filter(F.col("db_id").isin(db_ids))
    if keys is not None:
        some = [r[0] for r in keys.select("_key").distinct().limit(PUSHED_KEYS + 1).collect()]
        if len(some) <= PUSHED_KEYS:
            df = df.filter(F.col("key").isin(some))
        else:
            df = join_small_side(df, keys.select(F.col("_key").alias("key")).distinct(), ["key"], F.col("value"), how="left_semi")
    return df.select("db_id", "table_name", "column_name", "value", "value_type")


# Encodings tried in this order.
ENCODINGS = ("utf-8", "windows-1254", "iso-8859-9")


def decode_bytes(df: DataFrame, column: str) -> DataFrame:
    """A binary column as text by the first encoding that fits.

    Valid UTF-8 is decoded in the JVM; only the rest goes through Python, in Arrow
    batches. The last encoding accepts any byte, so nothing is left undecoded.
    """
    @F.pandas_udf("string")
    def fallback(values: pd.Series) -> pd.Series:
        def one(raw):
            for name in ENCODINGS[1:] if raw is not None else ():
                try:
                    return bytes(raw).decode(name)
                except UnicodeDecodeError:
                    continue
            return None
        return values.map(one)

    text = F.try_validate_utf8(F.col(column).cast("string"))
    rest = F.when(text.isNull(), F.col(column))
    return df.withColumn(column, F.coalesce(text, fallback(rest)))
