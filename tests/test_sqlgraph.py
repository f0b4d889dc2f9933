"""Hand-written graphs: aliases, functions, arithmetic, scopes and nested queries."""

from shotloom.operators.sqlgraph import graph_tables


def graph(spark, *queries):
    df = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    nodes, edges = graph_tables(df)
    n, e = {}, {}
    for r in nodes.collect():
        n.setdefault(r.qid, set()).add(r.node_id)
    for r in edges.collect():
        e.setdefault(r.qid, set()).add((r.src, r.dst, r.label))
    return [(n[i], e[i]) for i in range(len(queries))]


def names(nodes, prefix):
    return {x[len(prefix):] for x in nodes if x.startswith(prefix)}


def test_aliases_functions_and_arithmetic(spark):
    (a, ae), (b, be), (c, _), (d, de), (e, _) = graph(
        spark,
        "SELECT T1.c_name FROM customer T1 JOIN orders T2 ON T1.c_custkey = T2.o_custkey",
        "SELECT upper(c_name), c_acctbal + 10 * c_nationkey FROM customer WHERE -c_acctbal < 5 - 3",
        "SELECT a.x, b.y FROM t a, u AS b WHERE a.k / 2 = b.k",
        "SELECT T1.a FROM t AS T1 WHERE T1.b IN (SELECT T1.c FROM u AS T1 WHERE T1.d = 1) LIMIT 5 OFFSET 2",
        "SELECT v.x FROM (SELECT x FROM t) v WHERE count(*) > 1")
    assert names(a, "TABLE_") == {"customer", "orders"}
    assert names(a, "COLUMN_") == {"customer.c_name", "customer.c_custkey", "orders.o_custkey"}
    assert ("SQL_KEYWORD_SELECT_0", "TABLE_customer", "FROM") in ae and ("SQL_KEYWORD_JOIN_0", "TABLE_orders", "FROM") in ae

    assert names(b, "COLUMN_") == {"customer.c_name", "customer.c_acctbal", "customer.c_nationkey"}
    keywords = names(b, "SQL_KEYWORD_")
    assert {"ADD_0", "MUL_0", "NEG_0", "SUB_0", "LT_0"} <= keywords and "STAR" not in keywords
    assert ("SQL_KEYWORD_ADD_0", "COLUMN_customer.c_acctbal", "expressions") in be
    assert ("SQL_KEYWORD_MUL_0", "COLUMN_customer.c_nationkey", "expressions") in be

    assert names(c, "TABLE_") == {"t", "u"} and names(c, "COLUMN_") == {"t.x", "u.y", "t.k", "u.k"}
    assert "DIV_0" in names(c, "SQL_KEYWORD_")

    # the same alias means another table inside
    assert names(d, "COLUMN_") == {"t.a", "t.b", "u.c", "u.d"}
    assert ("SQL_KEYWORD_IN_0", "SQL_KEYWORD_SUBQUERY_0", "query") in de
    assert ("SQL_KEYWORD_SUBQUERY_0", "SQL_KEYWORD_SELECT_1", "this") in de
    assert ("SQL_KEYWORD_SELECT_1", "TABLE_u", "FROM") in de and "OFFSET_0" in names(d, "SQL_KEYWORD_")

    assert "STAR" in names(e, "SQL_KEYWORD_") and "t.x" in names(e, "COLUMN_") and "v" not in names(e, "TABLE_") - {"v"}


def test_only_joined_table_takes_unqualified_columns(spark):
    (n, _), = graph(spark, "SELECT y FROM (SELECT x FROM t) JOIN u ON y = 1")
    assert "u.y" in names(n, "COLUMN_") and "t.x" in names(n, "COLUMN_")
