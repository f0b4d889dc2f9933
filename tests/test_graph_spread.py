"""The SQL graph moves query texts once; its tokens, trees and columns stay in their partitions."""

import re

from pyspark.sql import functions as F

from shotloom.operators import augment as A
from shotloom.operators import sqlgraph as G

SQL = ("SELECT a.x FROM t AS a WHERE a.y IN (SELECT z FROM u WHERE z > {n}) AND x = 1 "
       "UNION SELECT x FROM t WHERE y < {n}")


def _log(spark):
    return spark.createDataFrame([(n, SQL.format(n=n)) for n in range(50)], "qid long, query string")


def _names(spark):
    return spark.createDataFrame([("t", "x"), ("t", "y"), ("u", "z")], "table_name string, column_name string")


def test_one_shuffle_of_texts(spark):
    for select in ("SELECT qid, pos, tok, kind FROM tk", "SELECT qid, node_id, val, type FROM nodes",
                   "SELECT qid, src, dst, label FROM edges",
                   "SELECT qid, pos, ctable FROM tk WHERE kind = 'column'"):
        df = G.graph_query(_log(spark), select, _names(spark))
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = [k for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if not k.startswith("column_name")]
        assert len(keys) == 1 and re.match(r"qid#\d+L?, \d+$", keys[0]), (select, keys)
        assert "SortMergeJoin" not in plan, select


def test_partitions_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "PART_BYTES", 64)
    small = G.spread_by_query(_log(spark), "qid", "query").rdd.getNumPartitions()
    large = G.spread_by_query(_log(spark).union(_log(spark)), "qid", "query").rdd.getNumPartitions()
    assert small >= 50 and large >= 2 * small - 1


def test_columns_of_enclosing_selects(spark):
    got = G.graph_query(_log(spark).limit(1), "SELECT tok, pos, ctable FROM tk WHERE kind = 'column' ORDER BY pos",
                        _names(spark)).collect()
    assert [(r.tok, r.ctable) for r in got] == [("a.x", "t"), ("a.y", "t"), ("z", "u"), ("z", "u"), ("x", "t"),
                                               ("x", "t"), ("y", "t")]


def _shuffle_keys(df):
    """Keys of the hash shuffles of the executed plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k).rsplit(", ", 1)[0] for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


def test_graph_operators_spread_rows_by_query(spark):
    """Edges are spread by qid alone, never by (qid, id) for each of their ends."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, edges = G.graph_tables(_log(spark), _names(spark))
        words = spark.createDataFrame([(0, "alpha"), (1, "beta")], "widx long, word string")
        one = nodes.filter("node_id = 'SQL_KEYWORD_WHERE_0'").select("qid", "node_id")
        hot = nodes.select("qid", "node_id", F.array(F.lit(1.0)).alias("h"))
        made = {"keyword": A.replace_keywords(nodes, edges, 0.7, 1)[1], "not": A.toggle_not(nodes, edges, 0.9, 1)[1],
                "value": A.replace_values(nodes, edges, words, 0.9, 1)[1], "delete": A.subgraph_delete(nodes, edges, one)[1],
                "reach": A.reachable(edges, one.withColumnRenamed("node_id", "node")), "hops": A.propagate(hot, edges, 2)}
        for name, df in made.items():
            assert set(_shuffle_keys(df)) == {"qid"}, (name, _shuffle_keys(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_reach_and_delete_of_odd_graphs(spark):
    """Cycles, a chain of 300, a graph without ROOT and one without edges."""
    chain = [(1, f"n{i}", f"n{i + 1}", "x") for i in range(300)]
    edges = spark.createDataFrame(chain + [(2, "ROOT", "a", "x"), (2, "a", "b", "x"), (2, "b", "a", "x"), (2, "ROOT", "c", "x"),
                                           (3, "a", "b", "x")], "qid long, src string, dst string, label string")
    got = A.reachable(edges, spark.createDataFrame([(1, "n0"), (2, "b"), (4, "z")], "qid long, node string")).collect()
    by = {q: {r.node for r in got if r.qid == q} for q in (1, 2, 3, 4)}
    assert len(by[1]) == 301 and by[2] == {"a", "b"} and by[3] == set() and by[4] == {"z"} and len(got) == 304
    nodes = spark.createDataFrame([(2, "ROOT", "ROOT", "ROOT"), *[(2, x, x, "TABLE") for x in "abc"], (3, "a", "a", "TABLE"),
                                   (5, "ROOT", "ROOT", "ROOT")], "qid long, node_id string, val string, type string")
    n, e = A.subgraph_delete(nodes, edges, spark.createDataFrame([(2, "a"), (2, "a")], "qid long, node_id string"))
    assert sorted((r.qid, r.node_id) for r in n.collect()) == [(2, "ROOT"), (2, "c"), (3, "a"), (5, "ROOT")]
    assert sorted((r.qid, r.src, r.dst) for r in e.filter("qid > 1").collect()) == [(2, "ROOT", "c"), (3, "a", "b")]
