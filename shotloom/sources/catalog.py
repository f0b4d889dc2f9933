"""Database catalogs derived from the registered tables' schemas.

A catalog row is (db_id, table_idx, table_name, col_idx, column_name, column_type,
ddl_type); ``col_idx`` 0 is the ``*`` column as in the original catalog files.
Keys are inferred by naming: a table's first column ending in ``key``/``id`` is its
primary key; a column whose key stem (name without a one-letter table prefix)
equals another table's primary-key stem is a foreign key to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from shotloom.sources.tables import load

# The four logical databases over the driver tables, tables in catalog order.
LOGICAL_DBS = {
    "star": ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"],
    "corpus": ["documents", "benchmark", "labels", "pages", "conversations"],
    "stream": ["events"],
    "vec": ["embeddings"],
}


def _kind(dt: Ty.DataType) -> str:
    if isinstance(dt, (Ty.ByteType, Ty.ShortType, Ty.IntegerType, Ty.LongType)):
        return "integer"
    if isinstance(dt, (Ty.FloatType, Ty.DoubleType, Ty.DecimalType)):
        return "real"
    if isinstance(dt, Ty.StringType):
        return "text"
    if isinstance(dt, (Ty.TimestampType, Ty.TimestampNTZType, Ty.DateType)):
        return "time"
    if isinstance(dt, Ty.BooleanType):
        return "boolean"
    return "other"


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per column of every table, plus one ``*`` row per table."""
    rows = []
    for db, tables in LOGICAL_DBS.items():
        for ti, t in enumerate(tables):
            for ordinal, f in enumerate(load(spark, sf_dir, t).schema.fields, start=1):
                rows.append((db, ti, t, ordinal, f.name, _kind(f.dataType)))
    schema = "db_id string, table_idx int, table_name string, ordinal int, column_name string, kind string"
    cols = spark.createDataFrame(rows, schema)
    w = Window.partitionBy("db_id").orderBy("table_idx", "ordinal")
    cols = cols.withColumn("col_idx", F.row_number().over(w).cast("bigint"))
    generic = (F.when(F.col("kind").isin("integer", "real"), "number")
                .when(F.col("kind") == "text", "text").when(F.col("kind") == "time", "time")
                .when(F.col("kind") == "boolean", "boolean").otherwise("others"))
    ddl = (F.when(F.col("kind") == "integer", "INTEGER").when(F.col("kind") == "real", "REAL")
            .when(F.col("kind") == "text", "TEXT").when(F.col("kind") == "time", "TIMESTAMP")
            .when(F.col("kind") == "boolean", "BOOLEAN").otherwise("BLOB"))
    return cols.select("db_id", F.col("table_idx").cast("bigint").alias("table_idx"), "table_name",
                       "col_idx", "column_name", generic.alias("column_type"), ddl.alias("ddl_type"),
                       F.col("ordinal").cast("bigint").alias("ordinal"))


def _stem(c):
    return F.when(c.rlike("^[a-z]_"), F.substring(c, 3, 1 << 20)).otherwise(c)


def primary_keys(cols: DataFrame) -> DataFrame:
    """(db_id, table_idx, table_name, column_name, col_idx) of each table's key column."""
    first = cols.filter((F.col("ordinal") == 1)
                        & (F.col("column_name").endswith("key") | F.col("column_name").endswith("id")))
    return first.select("db_id", "table_idx", "table_name", "column_name", "col_idx")


def foreign_keys(cols: DataFrame) -> DataFrame:
    """(db_id, table_name, column_name, ref_table, ref_column, col_idx) by key-stem match."""
    pk = primary_keys(cols).select("db_id", F.col("table_idx").alias("ref_idx"),
                                   F.col("table_name").alias("ref_table"),
                                   F.col("column_name").alias("ref_column"),
                                   _stem(F.col("column_name")).alias("stem"))
    c = cols.select("db_id", "table_idx", "table_name", "column_name", "col_idx", "ordinal",
                    _stem(F.col("column_name")).alias("stem"))
    fk = c.join(pk, ["db_id", "stem"]).filter(F.col("table_name") != F.col("ref_table"))
    is_pk = (F.col("ordinal") == 1)
    fk = fk.filter(~is_pk | (F.col("ref_idx") < F.col("table_idx")))
    return fk.select("db_id", "table_name", "column_name", "ref_table", "ref_column", "col_idx")


def flatten(cols: DataFrame) -> DataFrame:
    """(db_id, table_name, column_name, column_type) with ``*`` expanded per table."""
    star = cols.select("db_id", "table_idx", "table_name").distinct() \
               .select("db_id", "table_idx", "table_name", F.lit(0).cast("bigint").alias("col_idx"),
                       F.lit("*").alias("column_name"), F.lit("text").alias("column_type"))
    return star.unionByName(cols.select("db_id", "table_idx", "table_name", "col_idx",
                                        "column_name", "column_type"))


def schema_text(cols: DataFrame, sep: str = "\n\n") -> DataFrame:
    """``CREATE TABLE`` text per table, joined per db in catalog order."""
    per_table = (cols.groupBy("db_id", "table_idx", "table_name")
                     .agg(F.sort_array(F.collect_list(F.struct("ordinal", F.concat(
                         F.lit("  "), F.col("column_name"), F.lit(" "), F.col("ddl_type")).alias("d"))))
                         .alias("cs")))
    per_table = per_table.withColumn("ddl", F.concat(
        F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" (\n"),
        F.array_join(F.transform("cs", lambda x: x["d"]), ",\n"), F.lit("\n)")))
    return (per_table.groupBy("db_id")
                     .agg(F.sort_array(F.collect_list(F.struct("table_idx", "ddl"))).alias("ts"))
                     .select("db_id", F.array_join(F.transform("ts", lambda x: x["ddl"]), sep).alias("schema_text")))
