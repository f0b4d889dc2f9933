"""Graphs read text by text: no token rows, large catalogs, and rows that share a qid or have none."""

import random
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL

from shotloom.operators import augment as A
from shotloom.operators import sqlgraph as G
from shotloom.operators.graphfold import graph_of
from shotloom.plans.registry import QUERIES

SQL = ["SELECT a.x, y FROM t AS a JOIN u ON a.k = u.k WHERE a.y IN (SELECT z FROM u WHERE z > {n} AND NOT y = 'b') OR x = -1",
       "SELECT max(x) * 2 FROM t GROUP BY y HAVING count(*) > {n} UNION SELECT x FROM (SELECT z FROM u) v WHERE y BETWEEN 1 AND {n}",
       "SELECT ( FROM t, u WHERE 'open", "", "SELECT z FROM u WHERE z = {n}"]
NAMES = [("t", "x"), ("t", "y"), ("u", "z"), ("u", "k")]


def _names(spark):
    return spark.createDataFrame(NAMES, "table_name string, column_name string")


def _log(spark, qids):
    rng = random.Random(1)
    rows = [(q, rng.choice(SQL).format(n=rng.randint(0, 3))) for q in qids]
    return spark.createDataFrame(rows, "qid long, query string")


def test_no_token_is_a_row(spark):
    for select in ("SELECT qid, node_id, val, type FROM nodes", "SELECT qid, src, dst, label FROM edges"):
        plan = G.graph_query(_log(spark, range(50)), select, _names(spark))._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "posexplode" not in plan, select


def test_a_large_catalog_gives_the_same_graph(spark):
    log, got = _log(spark, range(60)), []
    for rows in ("2000000", "0"):
        spark.conf.set("shotloom.broadcast.maxRows", rows)
        try:
            n, e = G.graph_tables(log, _names(spark))
        finally:
            spark.conf.unset("shotloom.broadcast.maxRows")
        got.append((sorted(map(tuple, n.collect())), sorted(map(tuple, e.collect()))))
    assert got[0] == got[1] and any("belongs_to" in e for e in got[0][1])


def test_shared_and_missing_qids_read_as_the_token_statement(spark):
    """Exact copies under one qid, and rows without qid, against the windows and joins of the statement."""
    one = _log(spark, range(40))
    log = one.unionByName(one).unionByName(_log(spark, [None]))
    node_arr, edge_arr = G.graph_arrays("spark")
    tk = G.resolved_tokens(log, _names(spark))
    nodes, edges = G.graph_tables(log, _names(spark))
    want = (tk.select("qid", F.explode(F.expr(node_arr)).alias("x")).select("qid", "x.*").filter("a IS NOT NULL").distinct())
    assert sorted(map(str, want.collect())) == sorted(map(str, nodes.toDF("qid", "a", "b", "c").collect()))
    outside = (tk.select("qid", F.explode(F.expr(edge_arr)).alias("x")).select("qid", "x.*")
               .filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    assert set(map(tuple, outside.collect())) <= set(map(tuple, edges.collect()))


def test_the_trees_of_one_text():
    nodes, edges = graph_of(["SELECT x FROM t WHERE x = 1 AND NOT y LIKE 'q'"], {"x": {"t"}})
    kw = "SQL_KEYWORD_"
    assert (f"{kw}AND_0", f"{kw}EQ_0", "this") in edges and (f"{kw}AND_0", f"{kw}NOT_0", "expression") in edges
    assert (f"{kw}NOT_0", f"{kw}LIKE_0", "this") in edges and ("COLUMN_t.x", "x", "COLUMN") in nodes
    assert graph_of([""], {}) == ({}, {})


def test_tables_with_and_without_columns(spark):
    log = spark.createDataFrame([(1, "SELECT count(*) FROM t JOIN u ON t.y = 1 AND x = 2"), (2, ""), (None, "SELECT z FROM u")],
                                "qid long, query string")
    got = {(r.qid, r.table_node): (r.n_columns, r.columns) for r in G.tables_columns(G.graphs(log, _names(spark))).collect()}
    assert got == {(1, "TABLE_t"): (2, ["x", "y"]), (1, "TABLE_u"): (0, []), (None, "TABLE_u"): (1, ["z"])}


def _shuffle_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#\d+L?", "", k).rsplit(", ", 1)[0] for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)}


def test_words_are_counted_in_their_node(spark):
    assert not _shuffle_keys(QUERIES["node_features"](spark, SF_SMALL))


def test_vectors_move_graphs_by_query(spark):
    assert _shuffle_keys(QUERIES["graph_vectors"](spark, SF_SMALL)) == {"qid"}


def test_predicates_are_edited_in_one_spread_of_graphs(spark, monkeypatch):
    """One written table, of graphs that met in one shuffle by qid."""
    seen, plain = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, *a: seen.append(_shuffle_keys(df)) or plain(df, *a))
    nodes, edges = G.graph_tables(_log(spark, [*range(30), None]), _names(spark))
    n, e = A.predicate_modification(nodes, edges, 5)
    assert seen == [{"qid"}]
    whole = nodes.filter("qid IS NULL").count()
    assert n.filter("qid IS NULL").count() == whole and 0 < n.count() < nodes.count()
