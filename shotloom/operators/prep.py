"""Dataset preparation and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.operators.common import dense_index, join_small_side


def assign_idx(df: DataFrame, split: str = "split", pos: str = "pos") -> DataFrame:
    """Dense 0-based ``idx`` per split in file order (``pos``)."""
    return dense_index(df, [split], [pos], out="idx")


def db_paths(df: DataFrame, root: str = "datasets", split: str = "split",
             db_id: str = "db_id") -> DataFrame:
    """``<root>/<split>/database/<db>/<db>.sqlite`` per distinct (split, db)."""
    d = df.select(split, db_id).dropDuplicates([split, db_id])
    return d.withColumn("db_path", F.concat_ws("/", F.lit(root), F.col(split), F.lit("database"),
                                               F.col(db_id), F.concat(F.col(db_id), F.lit(".sqlite"))))


def overlay_preliminary(examples: DataFrame, prelim: DataFrame | None, keys: list[str],
                        query: str = "query", prelim_query: str = "prelim_query") -> DataFrame:
    """P5: replace the gold SQL by the preliminary SQL where a line exists (left join).

    A short file leaves the gold SQL of the rest; without a file (None) every query is empty.
    """
    if prelim is None:
        return examples.withColumn("gold_" + query, F.col(query)).withColumn(query, F.lit(""))
    j = examples.join(prelim.select(*keys, prelim_query), keys, "left")
    j = j.withColumn("gold_" + query, F.col(query)) \
         .withColumn(query, F.coalesce(F.col(prelim_query), F.col(query))).drop(prelim_query)
    return j


def first_n(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """rows with ``idx < n``; ``n <= 0`` keeps everything."""
    return df if n <= 0 else df.filter(F.col(idx) < n)


def keep_listed(df: DataFrame, listed: DataFrame, idx: str = "idx", pos: str = "pos") -> DataFrame:
    """keep rows whose ``idx`` is listed; ``pos`` carries the list order."""
    return join_small_side(df, listed.select(F.col(idx).cast("bigint").alias(idx), pos),
                           [idx], salt_of=F.col(idx))


def other_db(pairs: DataFrame, a: str = "a_db", b: str = "b_db") -> DataFrame:
    """theta condition keeping pairs from different databases."""
    return pairs.filter(F.col(a) != F.col(b))
