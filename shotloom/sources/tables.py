"""Driver tables and the views derived from them (examples, pool, query log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_all(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


# Fixed value: the query-log statement, shared verbatim by the Spark job and the
# DuckDB oracle (one SQL query per order, 12 shapes, deterministic).
QLOG_SQL = """SELECT o_orderkey AS qid,
       concat('db', cast(o_custkey % 20 AS string)) AS db_id,
       cast(o_orderkey % 12 AS bigint) AS shape,
       CASE o_orderkey % 12
         WHEN 0 THEN concat('How many orders does customer ', cast(o_custkey AS string), ' have?')
         WHEN 1 THEN 'How many orders are there for each order priority?'
         WHEN 2 THEN concat('Which customers have orders with status ', o_orderstatus, '?')
         WHEN 3 THEN concat('List the top ', cast(o_custkey % 9 + 1 AS string), ' building customers by account balance.')
         WHEN 4 THEN concat('Total order price per nation with more than ', cast(o_custkey % 50 AS string), ' orders?')
         WHEN 5 THEN 'Which customers have no orders?'
         WHEN 6 THEN concat('Which parts are larger than ', cast(o_custkey % 40 AS string), ' and cheaper than 950?')
         WHEN 7 THEN concat('Which parts are of brand ', cast(o_custkey % 25 AS string), ' or economy type?')
         WHEN 8 THEN concat('What is the maximum price of orders with a line of at least ', cast(o_custkey % 45 AS string), ' units?')
         WHEN 9 THEN concat('Which nation keys have suppliers and customers above ', cast(o_custkey % 100 AS string), ' balance?')
         WHEN 10 THEN 'How many orders are there per region, largest first?'
         ELSE concat('Which orders cost at least ', cast(o_custkey AS string), '?') END AS question,
       CASE o_orderkey % 12
         WHEN 0 THEN concat('SELECT count(*) FROM orders WHERE o_custkey = ', cast(o_custkey AS string))
         WHEN 1 THEN 'SELECT o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority'
         WHEN 2 THEN concat('SELECT DISTINCT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_orderstatus = ', chr(34), lower(o_orderstatus), chr(34))
         WHEN 3 THEN concat('SELECT c_name FROM customer WHERE c_mktsegment = ', chr(39), 'Building ', chr(39), ' ORDER BY c_acctbal DESC LIMIT ', cast(o_custkey % 9 + 1 AS string))
         WHEN 4 THEN concat('SELECT T3.n_name, sum(T2.o_totalprice) FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey JOIN nation AS T3 ON T1.c_nationkey = T3.n_nationkey GROUP BY T3.n_name HAVING count(*) > ', cast(o_custkey % 50 AS string))
         WHEN 5 THEN 'SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders'
         WHEN 6 THEN concat('SELECT p_name FROM part WHERE p_size > ', cast(o_custkey % 40 AS string), ' AND p_retailprice < 950')
         WHEN 7 THEN concat('SELECT p_name FROM part WHERE p_brand LIKE ', chr(39), '%#', cast(o_custkey % 25 AS string), '%', chr(39), ' OR p_type = ', chr(39), 'economy', chr(39))
         WHEN 8 THEN concat('SELECT max(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= ', cast(o_custkey % 45 AS string), ')')
         WHEN 9 THEN concat('SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > ', cast(o_custkey % 100 AS string))
         WHEN 10 THEN 'SELECT T4.r_name, count(*) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey JOIN nation AS T3 ON T2.c_nationkey = T3.n_nationkey JOIN region AS T4 ON T3.n_regionkey = T4.r_regionkey GROUP BY T4.r_name ORDER BY count(*) DESC'
         ELSE concat(repeat(chr(96), 3), 'sql', chr(10), 'select  o_orderkey', chr(10), ' from orders where o_totalprice > = ', cast(o_custkey AS string), ' ', repeat(chr(96), 3)) END AS query
FROM orders"""


def qlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log: (qid, db_id, shape, question, query), one row per order."""
    from shotloom.operators.common import spread
    # The orders DataFrame is bound as a statement parameter: no session-global view.
    stmt = QLOG_SQL.replace("\nFROM orders", "\nFROM {orders_df}")
    return spark.sql(stmt, orders_df=spread(load(spark, sf_dir, "orders")))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to build prompts for: ``benchmark`` (idx, question)."""
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("idx"), F.col("text").alias("question"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstration pool: ``documents`` (idx, question, db_id, cls)."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("question"),
        F.col("source").alias("db_id"), F.col("lang").alias("cls"))
