"""Operator trees and column scopes: hand-written graphs, and random SQL against the oracle's joins."""

import random

import pytest

from shotloom.operators import sqlgraph as G
from shotloom.operators.augment import predicate_modification, simplify_conditions

KW = "SQL_KEYWORD_"
CATALOG = [("t", "a"), ("t", "b"), ("u", "c"), ("u", "b"), ("w", "d"), ("w", "a")]


def graphs(spark, queries, catalog=None):
    df = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    cat = spark.createDataFrame(catalog, "table_name string, column_name string") if catalog else None
    return G.graph_tables(df, cat)


def edges_of(spark, *queries, catalog=None):
    _, edges = graphs(spark, queries, catalog)
    out = [set() for _ in queries]
    for r in edges.collect():
        out[r.qid].add((r.src.replace(KW, ""), r.dst.replace(KW, ""), r.label))
    return out


def test_operands_are_ordered_and_nested_by_precedence(spark):
    a, b, c, d, e, f = edges_of(
        spark,
        "SELECT a FROM t WHERE a = 1 AND b = 2 OR c LIKE 'x'",
        "SELECT a FROM t WHERE (a = 1 OR b = 2) AND NOT c IN (1, 2)",
        "SELECT a FROM t WHERE a BETWEEN 1 AND 2 AND b NOT IN (SELECT c FROM u) AND d IS NOT NULL",
        "SELECT a FROM t WHERE a = -5 AND f(g(1, 2 + 3), 4) < 2 * 3 + 4",
        "SELECT max(a + b) * 2, coalesce(a, b) - 3 FROM t GROUP BY a HAVING count(*) > 3 ORDER BY b DESC",
        "SELECT a FROM t WHERE a = 1 AND b = 2 AND c = 3")
    assert {("WHERE_0", "OR_0", "expressions"), ("OR_0", "AND_0", "this"), ("OR_0", "LIKE_0", "expression"),
            ("AND_0", "EQ_0", "this"), ("AND_0", "EQ_1", "expression")} <= a
    assert {("WHERE_0", "AND_0", "expressions"), ("AND_0", "PAREN_0", "this"), ("PAREN_0", "OR_0", "this"),
            ("AND_0", "NOT_0", "expression"), ("NOT_0", "IN_0", "this"), ("IN_0", "LITERAL_3", "expressions")} <= b
    assert {("AND_1", "AND_0", "this"), ("AND_0", "BETWEEN_0", "this"), ("BETWEEN_0", "LITERAL_1", "expression"),
            ("AND_0", "NOT_0", "expression"), ("IN_0", "COLUMN_t.b", "expressions"), ("IN_0", "SUBQUERY_0", "query"),
            ("AND_1", "NOT_1", "expression"), ("NOT_1", "COLUMN_t.d", "expressions")} <= c
    assert not any(s == "AND_2" for s, _, _ in c)  # the AND of BETWEEN is no connective
    assert {("EQ_0", "NEG_0", "expression"), ("NEG_0", "LITERAL_0", "this"), ("LT_0", "ADD_0", "this"),
            ("LT_0", "LITERAL_1", "this"), ("LT_0", "ADD_1", "expression"), ("ADD_1", "MUL_0", "this")} <= d
    assert {("SELECT_0", "MUL_0", "expressions"), ("MUL_0", "MAX_0", "this"), ("MAX_0", "ADD_0", "this"),
            ("SUB_0", "COLUMN_t.a", "expressions"), ("HAVING_0", "GT_0", "expressions"), ("GT_0", "COUNT_0", "this"),
            ("COUNT_0", "STAR", "this"), ("ORDER_0", "COLUMN_t.b", "expressions")} <= e
    assert {("WHERE_0", "AND_1", "expressions"), ("AND_1", "AND_0", "this"), ("AND_1", "EQ_2", "expression")} <= f


def test_columns_of_enclosing_selects(spark):
    a, b, c, d = edges_of(
        spark,
        "SELECT a, c FROM t, u WHERE b = c AND EXISTS (SELECT 1 FROM w WHERE d = c AND a = t.b)",
        "SELECT x.a FROM t AS x WHERE x.b IN (SELECT x.c FROM u AS x WHERE b = 1) AND a IN (SELECT d FROM w WHERE w.d = x.a)",
        "SELECT nothing FROM t, u",
        "SELECT c FROM t JOIN u ON a = c WHERE unknown = 1",
        catalog=CATALOG)
    owns = {x for x in a if x[2] == "belongs_to"}
    assert {("COLUMN_t.a", "TABLE_t", "belongs_to"), ("COLUMN_u.c", "TABLE_u", "belongs_to"),
            ("COLUMN_t.b", "TABLE_t", "belongs_to"), ("COLUMN_w.d", "TABLE_w", "belongs_to"),
            ("COLUMN_w.a", "TABLE_w", "belongs_to")} == owns
    assert ("EQ_1", "COLUMN_u.c", "expressions") in a  # found two SELECTs up
    assert {"COLUMN_t.a", "COLUMN_t.b", "COLUMN_u.c", "COLUMN_u.b", "COLUMN_w.d"} == {x[0] for x in b if x[2] == "belongs_to"}
    assert ("EQ_1", "COLUMN_t.a", "expressions") in b
    assert ("SELECT_0", "COLUMN_t.nothing", "expressions") in c  # not in the catalog: the FROM table
    assert {("EQ_0", "COLUMN_t.a", "expressions"), ("SELECT_0", "COLUMN_u.c", "expressions"),
            ("EQ_1", "COLUMN_t.unknown", "expressions")} <= d


def arithmetic(rng, d):
    r = rng.random()
    if d == 0 or r < 0.35:
        return rng.choice(["a", "b", "t.c", "1", "2.5", "'s'", "-a"])
    if r < 0.45:
        return f"({arithmetic(rng, d - 1)})"
    if r < 0.6:
        return f"{rng.choice(['f', 'max', 'count'])}({', '.join(arithmetic(rng, d - 1) for _ in range(rng.randint(1, 3)))})"
    if r < 0.65:
        return f"(select {arithmetic(rng, d - 1)} from u where {condition(rng, d - 1)})"
    return f"{arithmetic(rng, d - 1)} {rng.choice('+-*/')} {arithmetic(rng, d - 1)}"


def condition(rng, d):
    r = rng.random()
    if d > 0 and r < 0.35:
        return f"{condition(rng, d - 1)} {rng.choice(['and', 'or'])} {condition(rng, d - 1)}"
    if d > 0 and r < 0.45:
        return rng.choice(["not {}", "({})"]).format(condition(rng, d - 1))
    x, no = arithmetic(rng, max(0, d - 1)), rng.choice(["", "not "])
    if r < 0.6:
        inside = ", ".join(arithmetic(rng, max(0, d - 1)) for _ in range(rng.randint(1, 3)))
        return f"{x} {no}in ({rng.choice([inside, 'select d from w where ' + condition(rng, 0)])})"
    if r < 0.7:
        return f"{x} {no}between {arithmetic(rng, 0)} and {arithmetic(rng, 1)}"
    if r < 0.8:
        return rng.choice([f"{x} is {no}null", f"{x} {no}like 'q'", f"exists (select 1 from w where {condition(rng, 0)})"])
    return f"{x} {rng.choice(['=', '<', '>=', '<>'])} {arithmetic(rng, d)}"


def test_random_queries_match_the_joins(spark, duck):
    rng = random.Random(4)
    queries = []
    for _ in range(400):
        q = (f"select {', '.join(arithmetic(rng, 2) for _ in range(rng.randint(1, 3)))} from t join u on {condition(rng, 1)} "
             f"where {condition(rng, 3)}")
        q += rng.choice(["", f" group by a, b having {condition(rng, 1)}", f" union select {arithmetic(rng, 1)} from u"])
        queries.append(q)
    queries += ["", "select", "a and and b", "select ( from ) where", "select a, , b from t where or"]
    names = [(t, c) for t, c in CATALOG]
    nodes, edges = graphs(spark, queries, names)
    df = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    duck.register("log_rows", df.select("qid", G.clean_for_graph(df.query).alias("q")).toPandas())
    values = ", ".join(f"('{t}', '{c}')" for t, c in names)
    for select, got in (("SELECT qid, src, dst, label FROM edges", edges), ("SELECT qid, node_id, val, type FROM nodes", nodes)):
        sql = G.duck_graph_query("SELECT qid, q FROM log_rows", select)
        at = sql.index("gcat AS (")
        sql = sql[:at] + f"gcat(table_name, column_name) AS (VALUES {values})" + sql[sql.index("),\nsel AS") + 1:]
        want, have = set(duck.execute(sql).fetchall()), {tuple(r) for r in got.collect()}
        wrong = sorted({x[0] for x in have ^ want if x[0] < 400}, key=lambda i: len(queries[i]))
        assert not wrong, (queries[wrong[0]], [x for x in have ^ want if x[0] == wrong[0]])


def test_long_lists_and_deep_nesting(spark):
    many = ", ".join(map(str, range(3000)))
    deep = "(" * 60 + "a = 1" + ")" * 60
    a, b = edges_of(spark, f"SELECT a FROM t WHERE a IN ({many}) AND b = 1", f"SELECT a FROM t WHERE {deep}")
    assert sum(s == "IN_0" for s, _, _ in a) == 3001
    assert ("PAREN_59", "EQ_0", "this") in b and ("PAREN_0", "PAREN_1", "this") in b


def simplified(spark, query, seed=1):
    nodes, edges = graphs(spark, [query])
    n, e = simplify_conditions(nodes, edges, seed, prob=1.0)
    return ({r.node_id.replace(KW, "") for r in n.collect()},
            {(r.src.replace(KW, ""), r.dst.replace(KW, ""), r.label) for r in e.collect()})


@pytest.mark.parametrize("seed", range(4))
def test_simplify_keeps_one_operand(spark, seed):
    n, e = simplified(spark, "SELECT a FROM t WHERE b = 1 AND c = 2", seed)
    kept = {x for x in n if x.startswith("EQ_")}
    assert len(kept) == 1 and "AND_0" not in n and ("WHERE_0", kept.pop(), "expressions") in e
    assert ("COLUMN_t.b" in n) != ("COLUMN_t.c" in n) and "COLUMN_t.a" in n  # what the rest still uses stays
    assert all(s in n and d in n for s, d, _ in e)


def test_simplify_prefers_connectives_and_shares_nodes(spark):
    for seed in range(6):
        n, e = simplified(spark, "SELECT b FROM t WHERE b = 1 AND c = 2 OR b = 3", seed)
        if "OR_0" in n:  # the AND went: one of its two conditions is the left operand now
            assert "AND_0" not in n and len([x for x in e if x[0] == "OR_0"]) == 2
        else:  # the OR went: its AND is kept, not the plain condition
            assert ("WHERE_0", "AND_0", "expressions") in e and "EQ_2" not in n
        assert "COLUMN_t.b" in n
    n, e = simplified(spark, "SELECT b FROM t WHERE b = 1")
    assert "EQ_0" in n and "WHERE_0" in n  # nothing to simplify


def test_predicate_branches(spark):
    queries = ["SELECT a FROM t WHERE b = 1 AND c = 2 GROUP BY a HAVING count(*) > 1"] * 300
    nodes, edges = graphs(spark, queries)
    n, e = predicate_modification(nodes, edges, 5)
    left = {}
    for r in n.collect():
        left.setdefault(r.qid, set()).add(r.node_id.replace(KW, ""))
    share = [sum(k in v for v in left.values()) / 300 for k in ("WHERE_0", "AND_0", "HAVING_0")]
    assert abs(share[0] - 0.7) < 0.1 and abs(share[1] - 0.35) < 0.1 and abs(share[2] - 0.8) < 0.1
    assert all("ROOT" in v and "COLUMN_t.a" in v for v in left.values()) and len(left) == 300
    known = {(r.qid, r.node_id) for r in n.collect()}
    assert all((r.qid, r.src) in known and (r.qid, r.dst) in known for r in e.collect())
