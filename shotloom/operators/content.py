"""Database content index and literal repair (V1-V7).

The index is a normalised table (db_id, table_name, column_name, value, value_type),
never a nested map. Repair explodes the quoted literals of every query, looks each one up
by exact value and by its ``lower(trim())`` key, and re-assembles the query from
the n+1 gaps ``split`` leaves around the n literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from shotloom.functions.constants import LITERAL_RE
from shotloom.operators.common import join_small_side, stored
from shotloom.sources.tables import load


def cell(field: Ty.StructField) -> Column | None:
    """``(column_name, value, value_type)`` of a scalar column, None for a nested or binary one.

    Values are text that does not depend on the engine: numbers without trailing zeros
    (six decimals at most), times to the microsecond.
    """
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, Ty.StringType):
        kind, text = "text", c
    elif isinstance(t, (Ty.FloatType, Ty.DoubleType, Ty.DecimalType)):
        plain = F.regexp_replace(c.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
        kind, text = "number", F.coalesce(plain, c.cast("string"))  # NaN and infinities have no decimal
    elif isinstance(t, Ty.IntegralType):
        kind, text = "number", c.cast("string")
    elif isinstance(t, Ty.BooleanType):
        kind, text = "boolean", c.cast("string")
    elif isinstance(t, (Ty.TimestampType, Ty.TimestampNTZType)):
        kind, text = "time", F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(t, Ty.DateType):
        kind, text = "time", F.date_format(c, "yyyy-MM-dd")
    else:
        return None
    return F.struct(F.lit(field.name).alias("column_name"), text.alias("value"), F.lit(kind).alias("value_type"))


def table_index(df: DataFrame, db: str, table: str, text_only: bool = False) -> DataFrame | None:
    """Distinct non-null values of every scalar (or text) column of a table, in one scan; None if it has none."""
    fields = [f for f in df.schema.fields if not text_only or isinstance(f.dataType, Ty.StringType)]
    cells = [c for c in map(cell, fields) if c is not None]
    if not cells:
        return None
    rows = df.select(F.explode(F.array(*cells)).alias("cell")).select(
        F.lit(db).alias("db_id"), F.lit(table).alias("table_name"), "cell.column_name", "cell.value", "cell.value_type")
    return rows.filter(F.col("value").isNotNull()).distinct()


def content_index(spark: SparkSession, sf_dir: str, dbs: dict[str, list[str]], text_only: bool = False) -> DataFrame | None:
    """V1: distinct non-null values of every scalar column of every table, one scan and one shuffle per table.

    ``text_only`` reads the text columns alone, for repairs. None if there is no such column.
    """
    parts = [table_index(load(spark, sf_dir, t), db, t, text_only) for db, tables in dbs.items() for t in tables]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def log_databases(rows: DataFrame, catalog: DataFrame, db: str = "db_id", query: str = "query") -> DataFrame:
    """``(db_id, content_db)``: the database that each of the log's ids means.

    It is the catalog database whose tables the id's queries name most often (ties: the
    first by name); ids that name no known table have none. ``catalog`` holds
    ``(db_id, table_name)``.
    """
    tables = catalog.select(F.col("db_id").alias("content_db"), F.lower("table_name").alias("word")).distinct()
    words = rows.select(db, F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))))
                        .alias("word")).groupBy(db, "word").count()
    named = join_small_side(words, tables, ["word"], F.col("word")).groupBy(db, "content_db").agg(F.sum("count").alias("n"))
    return (named.groupBy(db).agg(F.min(F.struct((-F.col("n")).alias("n"), "content_db"))["content_db"].alias("content_db")))


def db_values(index: DataFrame) -> DataFrame:
    """V2: distinct values per database."""
    return index.select("db_id", "value").distinct()


def value_variants(values: DataFrame) -> DataFrame:
    """V3: spelling variants of text values grouped by ``lower(trim(value))``; the chosen variant is the smallest (X11)."""
    return (values.withColumn("key", F.lower(F.trim(F.col("value"))))
                  .groupBy("db_id", "key")
                  .agg(F.min("value").alias("variant"), F.count("*").alias("n_variants")))


def literal_keys(rows: DataFrame, db: str = "db_id", query: str = "query") -> DataFrame:
    """Distinct ``(db, _key)`` of the log's quoted literals, the only keys that a repair looks up."""
    lits = rows.select(db, F.explode_outer(F.regexp_extract_all(F.col(query), F.lit(LITERAL_RE), 1)).alias("lit"))
    return lits.filter(F.col("lit").isNotNull()).select(db, F.lower(F.trim(F.col("lit"))).alias("_key")).distinct()


def repair_log(rows: DataFrame, index: DataFrame, row_id: str = "qid", db: str = "content_db",
               query: str = "query") -> DataFrame:
    """V2-V6 for a whole log: only text values whose key some literal has are taken from the index.

    An exact value and its variants share their key, so nothing else can matter; the
    index is read once, and what is grouped and joined grows with the literals.
    """
    keys = stored(literal_keys(rows, db, query), "literal-keys")
    text = index.filter(F.col("value_type") == "text").select(F.col("db_id").alias(db), "value",
                                                              F.lower(F.trim(F.col("value"))).alias("_key"))
    near = join_small_side(text, keys, [db, "_key"], F.col("value"), how="left_semi")
    values = stored(near.select(F.col(db).alias("db_id"), "value").distinct(), "literal-values")
    return repair_literals(rows, values, value_variants(values), row_id, db, query)


def repair_literals(rows: DataFrame, values: DataFrame, variants: DataFrame,
                    row_id: str = "qid", db: str = "db_id", query: str = "query") -> DataFrame:
    """V4-V6: rewrite every quoted literal; all literals are re-quoted with ``'``.

    A literal found verbatim is kept; otherwise its variant (if any) replaces it.
    ``changed`` is true when some literal's text changed (re-quoting alone is not a change).
    """
    lits = rows.select(row_id, db, F.posexplode_outer(F.regexp_extract_all(F.col(query), F.lit(LITERAL_RE), 1))
                       .alias("pos", "lit")).filter(F.col("lit").isNotNull())
    exact = values.select(F.col("db_id").alias(db), F.col("value").alias("lit"), F.lit(True).alias("in_db"))
    lits = join_small_side(lits, exact, [db, "lit"], salt_of=F.col(row_id), how="left")
    var = variants.select(F.col("db_id").alias(db), F.col("key").alias("_key"), "variant")
    lits = lits.withColumn("_key", F.lower(F.trim(F.col("lit"))))
    lits = join_small_side(lits, var, [db, "_key"], salt_of=F.col(row_id), how="left")
    new = F.when(F.col("in_db"), F.col("lit")).when(F.col("variant").isNotNull(), F.col("variant")) \
           .otherwise(F.col("lit"))
    lits = lits.withColumn("new", new).withColumn("chg", F.col("new") != F.col("lit"))
    per = (lits.groupBy(row_id)
               .agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("news"),
                    F.max(F.col("chg").cast("int")).alias("_chg")))
    out = rows.join(per, row_id, "left")
    gaps = F.split(F.col(query), LITERAL_RE, -1)
    n = F.size(F.col("news"))
    rebuilt = F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), n - 1),
                                 lambda i: F.concat(F.element_at(gaps, i + 1), F.lit("'"),
                                                    F.element_at(F.col("news"), i + 1)["new"], F.lit("'"))), ""),
        F.element_at(gaps, n + 1))
    out = out.withColumn("repaired", F.when(F.col("news").isNull(), F.col(query)).otherwise(rebuilt))
    out = out.withColumn("changed", F.coalesce(F.col("_chg"), F.lit(0)) == 1)
    return out.drop("news", "_chg")


def repair_report(repaired: DataFrame) -> DataFrame:
    """V7: number of rows and of changed rows (the changed ids stay a filter, not a list)."""
    return repaired.agg(F.count("*").alias("n_rows"),
                        F.sum(F.col("changed").cast("int")).cast("bigint").alias("n_changed"))
