"""Shared helpers of the training-data operators: tables, stored intermediates, word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.operators.common import discard, join_small_side, stored, top_k  # noqa: F401  for the operators

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000, size: str = "4m") -> DataFrame:
    """``df``, with the session's Arrow batches held to ``rows`` rows and ``size`` for whole texts.

    Ten thousand texts, the default, are tens of megabytes several times over in
    every task. Fewer rows set by the session stay.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def word_count(text: Column) -> Column:
    """Words of a text as a long (0 for null): every maximal run of non-space counts once."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample_per_group(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash of doc_id (about; exactly all of a small group).

    Only rows in the lowest part of the hash space that is expected to hold 1.5 n of
    the group are ranked, so what meets in one task does not grow with the input.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_c"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).cast("double") / (1 << 32)
    low = join_small_side(rows, counts, [group], F.col("doc_id")).withColumn("_u", u) \
        .filter(F.col("_u") * F.col("_c") <= 1.5 * n + 10)
    return top_k(low, [group], [F.col("_u"), F.col("doc_id")], n).drop("_c", "_u", "rank")


def as_bytes(col: pa.Array) -> list:
    """An Arrow string column as Python bytes (None stays None), without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(start, rows) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        out.append((at, end - at))
        at = end
    return out


class WordHash(dict):
    """64-bit hashes of words, cached for the batch of frequent ones up to ``limit`` entries."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
