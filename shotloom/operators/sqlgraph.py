"""SQL text -> labelled graph tables (G1-G12), as windowed token jobs.

No parser: each query is lexed into tokens; sub-query depth comes from matching
parentheses with window sums, and a token's scope is the last SELECT at its depth.
The graph (our own definition):

* nodes ROOT; SQL_KEYWORD_<KIND>_<n> for clauses, set operations, connectives,
  comparisons, aggregates and literals (numbered per query and kind by
  position), arithmetic, grouping parentheses (PAREN) and nested queries; one shared
  SQL_KEYWORD_STAR; TABLE_<t>; COLUMN_<t>.<c>; VALUE_<v>;
* edges ROOT -> set operation -> SELECT, SELECT -> clause, clause -> expression,
  LITERAL -> VALUE (``VALUE``), COLUMN -> TABLE (``belongs_to``), SELECT/JOIN -> TABLE
  (``FROM``), operator -> nested SELECT (``query``);
* expressions are operator-precedence trees: an operator's parent is the nearest
  operator of lower precedence on either side (the higher of the two), so AND and
  OR have two ordered operands: ``this`` is the left one, ``expression`` the right.
  Parentheses raise the precedence of what they hold; functions are no nodes, their
  arguments belong to the operator around them. The AND of a BETWEEN is no connective.
* a column belongs to the nearest enclosing SELECT that names its qualifier, or, if
  unqualified, that reads a table with such a column in the catalog. Without a catalog
  entry the FROM table of its own SELECT is taken, else its only table, else it is
  UNRESOLVED.

The token statement and the column resolution are portable between Spark SQL and
DuckDB except for a few dialect macros. The graphs are built twice over: Spark reads each
text token by token and folds each SELECT's tokens with a stack (:mod:`graphfold`), the
oracle uses the windows of the statement and joins each token with its neighbours of lower
precedence.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.operators import graphfold
from shotloom.operators.common import broadcast_if_bounded, stored
from shotloom.sources.tables import TABLES

# Fixed pattern: SQL lexer (quoted literal, identifier with optional qualifier, number, operator, symbol).
LEX_RE = r"'[^']*'|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?|[0-9]+(?:\.[0-9]+)?|>=|<=|!=|<>|[^\sA-Za-z0-9_]"


def _dialect(engine: str) -> dict:
    if engine == "spark":
        pat = '"' + LEX_RE.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return {
            # OUTER + IS NOT NULL: a plain explode makes the optimizer add a size() filter
            # that would run the lexer regex twice.
            "toks": f"SELECT qid, CAST(p.pos + 1 AS BIGINT) AS pos, p.tok FROM src "
                    f"LATERAL VIEW OUTER posexplode(regexp_extract_all(q, {pat}, 0)) p AS pos, tok "
                    f"WHERE p.tok IS NOT NULL",
            "last": "last({x}, true)",
            "struct": "named_struct('a', {a}, 'b', {b}, 'c', {c})",
            "explode": "SELECT qid, e.a, e.b, e.c FROM {src} LATERAL VIEW explode({arr}) x AS e",
            "arr": "array({items})",
        }
    pat = "'" + LEX_RE.replace("'", "''") + "'"
    return {
        "toks": f"SELECT qid, CAST(generate_subscripts(t, 1) AS BIGINT) AS pos, unnest(t) AS tok "
                f"FROM (SELECT qid, regexp_extract_all(q, {pat}, 0) AS t FROM src)",
        "last": "last_value({x} IGNORE NULLS)",
        "struct": "struct_pack(a := {a}, b := {b}, c := {c})",
        "explode": "SELECT qid, e.a, e.b, e.c FROM (SELECT qid, unnest({arr}) AS e FROM {src})",
        "arr": "[{items}]",
    }


# Precedence inside one parenthesis level; a level adds 10, operands are above all.
LEAF = graphfold.LEAF
CLAUSE_EDGE = "expressions"


def token_ctes(engine: str) -> str:
    """CTE chain over ``src(qid, q)`` up to ``tt``, the classified tokens of each query.

    Every CTE is read once, in one linear chain of windows within a query, so engines that inline CTEs do not recompute anything.
    """
    d = _dialect(engine)

    def last(x):
        return d["last"].format(x=x)

    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    q1 = "chr(39)"
    # fixed words: clause words, words that are no names, and what cannot end an operand
    parts = "'select', 'from', 'join', 'on', 'where', 'group', 'having', 'order', 'limit', 'union', 'except', 'intersect'"
    plain = ("'from', 'by', 'as', 'on', 'asc', 'desc', 'is', 'null', 'exists', 'left', 'right', 'inner', 'outer', "
             "'full', 'cross', 'natural', 'using', 'case', 'when', 'then', 'else', 'end', 'all'")
    no_operand = (plain + ", 'select', 'where', 'having', 'limit', 'offset', 'distinct', 'and', 'or', 'not', 'in', "
                  "'between', 'like', '=', '!=', '<>', '>', '>=', '<', '<=', '+', '-', '*', '/', '(', ',', '.'")
    ends_operand = f"prv IS NOT NULL AND prv NOT IN ({no_operand})"
    head = f"""toks AS ({d['toks']}),
t1 AS (SELECT qid, pos, tok, lower(tok) AS lt,
         lower(substr(tok, 1, 1)) BETWEEN 'a' AND 'z' OR substr(tok, 1, 1) = '_' AS word,
         lead(lower(tok)) OVER (PARTITION BY qid ORDER BY pos) AS nxt,
         lag(lower(tok)) OVER (PARTITION BY qid ORDER BY pos) AS prv,
         lag(tok) OVER (PARTITION BY qid ORDER BY pos) AS prv1,
         lag(tok, 2) OVER (PARTITION BY qid ORDER BY pos) AS prv2,
         {last(f"CASE WHEN lower(tok) IN ({parts}) THEN lower(tok) END")} OVER (PARTITION BY qid ORDER BY pos {before}) AS part,
         sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END)
             OVER (PARTITION BY qid ORDER BY pos {upto}) AS pincl
       FROM toks),
t1b AS (SELECT *, {last("CASE WHEN lt IN ('and', 'or', 'between') THEN lt END")}
                  OVER (PARTITION BY qid, pincl ORDER BY pos {before}) AS conn FROM t1),
t2a AS (SELECT *, CASE
   WHEN substr(tok, 1, 1) = {q1} OR substr(tok, 1, 1) BETWEEN '0' AND '9' THEN 'literal'
   WHEN tok = '(' AND nxt = 'select' THEN 'sub'
   WHEN tok = '(' AND prv IN ({no_operand}) AND prv NOT IN ('in', 'from', 'using', 'exists', 'all') THEN 'paren'
   WHEN lt = 'and' AND conn = 'between' THEN 'kw'
   WHEN lt IN ('except', 'intersect', 'union') THEN 'setop'
   WHEN lt IN ('select', 'where', 'having', 'limit', 'offset', 'join', 'distinct') THEN 'clause'
   WHEN lt IN ('group', 'order') AND nxt = 'by' THEN 'clause'
   WHEN lt IN ('count', 'sum', 'avg', 'min', 'max') AND nxt = '(' THEN 'agg'
   WHEN lt IN ('and', 'or', 'not', 'in', 'between', 'like', '=', '!=', '<>', '>', '>=', '<', '<=', '+', '-', '/') THEN 'op'
   WHEN tok = '*' AND ({ends_operand}) THEN 'op'
   WHEN tok = '*' THEN 'star'
   WHEN lt IN ({plain}) THEN 'kw'
   WHEN word AND nxt = '(' THEN 'func'
   WHEN word AND (prv IN ('from', 'join') OR prv = ',' AND part IN ('from', 'join')) THEN 'table'
   WHEN word AND prv = 'as' THEN 'alias'
   -- a name right after a table, or after a query in FROM, is its alias
   WHEN word AND part IN ('from', 'join') AND (prv = ')' OR lower(prv2) IN ('from', 'join', ',')) THEN 'alias'
   WHEN word THEN 'column'
   ELSE 'punct' END AS kind FROM t1b),
t2 AS (SELECT *, CASE WHEN kind IN ('clause', 'setop', 'agg') THEN upper(lt)
                      WHEN kind = 'op' THEN CASE lt WHEN '=' THEN 'EQ' WHEN '!=' THEN 'NEQ' WHEN '<>' THEN 'NEQ'
                           WHEN '>' THEN 'GT' WHEN '>=' THEN 'GTE' WHEN '<' THEN 'LT' WHEN '<=' THEN 'LTE'
                           WHEN '+' THEN 'ADD' WHEN '/' THEN 'DIV' WHEN '*' THEN 'MUL'
                           WHEN '-' THEN CASE WHEN {ends_operand} THEN 'SUB' ELSE 'NEG' END ELSE upper(lt) END
                      WHEN kind = 'sub' THEN 'SUBQUERY' WHEN kind = 'paren' THEN 'PAREN'
                      WHEN kind = 'literal' THEN 'LITERAL' END AS kw FROM t2a),
t3 AS (SELECT *, CASE WHEN kw IS NOT NULL THEN row_number() OVER (PARTITION BY qid, kw ORDER BY pos) END AS kwn FROM t2),
t4 AS (SELECT *, CASE WHEN tok = '(' THEN pincl WHEN tok = ')' THEN pincl + 1 END AS plevel,
                 CASE WHEN tok = '(' THEN (CASE WHEN nxt = 'select' THEN 1 ELSE 0 END) END AS opensub,
                 CASE WHEN kw IS NOT NULL THEN 'SQL_KEYWORD_' || kw || '_' || CAST(kwn - 1 AS STRING) END AS klabel
          FROM t3),
t5 AS (SELECT *, CASE WHEN tok = ')' THEN {last('opensub')} OVER (PARTITION BY qid, plevel ORDER BY pos {upto}) END
                 AS closesub FROM t4),
t6 AS (SELECT *, sum(CASE WHEN tok = '(' AND opensub = 1 THEN 1 WHEN tok = ')' AND closesub = 1 THEN -1 ELSE 0 END)
                 OVER (PARTITION BY qid ORDER BY pos {upto})
                 - CASE WHEN tok = '(' AND opensub = 1 THEN 1 ELSE 0 END AS depth,
                 {last("CASE WHEN kind IN ('clause', 'op', 'agg', 'setop', 'sub') THEN klabel END")} OVER (PARTITION BY qid ORDER BY pos {before}) AS last_any,
                 lag(klabel) OVER (PARTITION BY qid ORDER BY pos) AS prv_label
          FROM t5),
t7 AS (SELECT *, coalesce({last("CASE WHEN lt = 'select' THEN pos END")} OVER (PARTITION BY qid, depth ORDER BY pos {upto}), 0) AS scope,
                 {last("CASE WHEN lt = 'select' THEN klabel END")} OVER (PARTITION BY qid, depth ORDER BY pos {upto}) AS scope_select,
                 max(CASE WHEN kind = 'setop' AND depth = 0 THEN klabel END) OVER (PARTITION BY qid) AS top_setop,
                 pincl - CASE WHEN tok = '(' THEN 1 ELSE 0 END - depth AS lvl,
                 CASE WHEN kind = 'column' AND instr(tok, '.') > 0 THEN split_part(tok, '.', 1) END AS qual
          FROM t6),
t8 AS (SELECT *, CASE WHEN kind = 'alias' THEN lower(tok) ELSE lower(qual) END AS aname,
                 CASE WHEN kind = 'alias' THEN nullif(CASE WHEN prv = 'as' THEN prv2 ELSE prv1 END, ')') END AS atable FROM t7),
t9 AS (SELECT *, max(atable) OVER (PARTITION BY qid, aname) AS any_table,
                 max(CASE WHEN kind = 'table' AND prv = 'from' THEN tok END) OVER (PARTITION BY qid, scope) AS from_table,
                 min(CASE WHEN kind = 'table' THEN tok END) OVER (PARTITION BY qid, scope) AS low_table,
                 max(CASE WHEN kind = 'table' THEN tok END) OVER (PARTITION BY qid, scope) AS high_table,
                 lvl - coalesce(max(CASE WHEN lt = 'select' THEN lvl END) OVER (PARTITION BY qid, scope), 0) AS rel FROM t8),
-- how a token takes part in expressions, and how firmly it binds
tt AS (SELECT *, CASE WHEN kind IN ('clause', 'setop') THEN 'clause'
                      WHEN kind IN ('literal', 'star', 'column', 'sub') THEN 'leaf'
                      WHEN kind IN ('agg', 'paren') OR kw = 'NEG' THEN 'prefix'
                      WHEN kw = 'NOT' AND nxt IN ('in', 'like', 'between') THEN 'negates'
                      WHEN kw = 'NOT' AND coalesce(prv, '') <> 'is' THEN 'prefix'
                      WHEN kind = 'op' THEN 'binary'
                      WHEN lt = 'and' AND kind = 'kw' THEN 'bar'
                      WHEN lt IN (',', 'on', 'as', 'from', 'by', 'asc', 'desc', 'case', 'when', 'then', 'else', 'end', 'using')
                      THEN 'bar' END AS take,
                 CAST(CASE WHEN kind IN ('clause', 'setop') THEN -1
                      WHEN kind IN ('literal', 'star', 'column', 'sub') THEN {LEAF}
                      ELSE 10 * rel + CASE WHEN kind IN ('agg', 'paren') THEN 9
                           WHEN lt = 'and' AND kind = 'kw' THEN 5 WHEN kind <> 'op' THEN 0 WHEN kw = 'OR' THEN 1 WHEN kw = 'AND' THEN 2
                           WHEN kw = 'NOT' THEN CASE WHEN prv = 'is' THEN 4 ELSE 3 END
                           WHEN kw IN ('ADD', 'SUB') THEN 6 WHEN kw IN ('MUL', 'DIV') THEN 7 WHEN kw = 'NEG' THEN 8
                           ELSE 4 END END AS BIGINT) AS prec
       FROM t9)"""
    return head


#: Over ``tt`` and ``gcat(table_name, column_name)`` (lower case): ``best``, the table of each column that some
#: enclosing SELECT names (its qualifier) or whose tables hold it. A SELECT encloses a token if it is the last one
#: before it at its depth or a lower one.
RESOLVE_CTES = """sel AS (SELECT qid, pos AS spos, depth AS sdepth FROM tt WHERE lt = 'select'),
col AS (SELECT qid, pos, depth, lower(qual) AS q, lower(CASE WHEN qual IS NULL THEN tok ELSE split_part(tok, '.', 2) END) AS c
        FROM tt WHERE kind = 'column'),
anc AS (SELECT col.qid, col.pos, col.q, col.c, sel.sdepth, max(sel.spos) AS scope
        FROM col JOIN sel ON sel.qid = col.qid AND sel.spos < col.pos AND sel.sdepth <= col.depth
        GROUP BY col.qid, col.pos, col.q, col.c, sel.sdepth),
named AS (SELECT qid, scope, pos AS npos, lower(tok) AS name, CASE WHEN kind = 'table' THEN tok ELSE atable END AS tbl,
                 kind FROM tt WHERE kind = 'table' OR kind = 'alias' AND atable IS NOT NULL),
hits AS (SELECT anc.qid, anc.pos, anc.sdepth, n.npos, n.tbl FROM anc JOIN named n
           ON n.qid = anc.qid AND n.scope = anc.scope AND n.name = anc.q
         UNION ALL
         SELECT anc.qid, anc.pos, anc.sdepth, n.npos, n.tbl FROM anc JOIN named n
           ON n.qid = anc.qid AND n.scope = anc.scope AND anc.q IS NULL AND n.kind = 'table'
         JOIN gcat ON gcat.table_name = n.name AND gcat.column_name = anc.c),
best AS (SELECT qid, pos, tbl FROM (
           SELECT qid, pos, tbl, row_number() OVER (PARTITION BY qid, pos ORDER BY sdepth DESC, npos) AS k FROM hits) z
         WHERE k = 1)"""

#: Over ``tt`` and ``best``: the tokens with column names and tables.
TK = """SELECT tt.*, CASE WHEN kind = 'column' AND qual IS NOT NULL THEN split_part(tok, '.', 2) ELSE tok END AS cname,
         CASE WHEN kind <> 'column' THEN NULL WHEN best.tbl IS NOT NULL THEN best.tbl
              WHEN qual IS NOT NULL THEN coalesce(any_table, qual)
              WHEN from_table IS NOT NULL THEN from_table WHEN low_table = high_table THEN low_table END AS ctable
       FROM tt LEFT JOIN best ON best.qid = tt.qid AND best.pos = tt.pos"""

_COLUMN = "'COLUMN_' || coalesce(ctable, 'UNRESOLVED') || '.' || cname"
#: The graph's label of a token that is an operator or operand.
_NAME = f"CASE kind WHEN 'column' THEN {_COLUMN} WHEN 'star' THEN 'SQL_KEYWORD_STAR' ELSE klabel END"


def graph_arrays(engine: str) -> tuple[str, str]:
    """Expressions over a row of ``tk``: the arrays of its nodes and of its edges outside the trees, as (a, b, c)."""
    d = _dialect(engine)

    def st(a, b, c):
        return d["struct"].format(a=a, b=b, c=c)

    def arr(*items):
        return d["arr"].format(items=", ".join(items))

    q1 = "chr(39)"
    null3 = st("CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
    value_node = f"'VALUE_' || replace(tok, {q1}, '')"
    node_arr = arr(
        f"CASE WHEN pos = 1 THEN {st(repr('ROOT'), repr('ROOT'), repr('ROOT'))} ELSE {null3} END",
        f"""CASE WHEN klabel IS NOT NULL THEN {st('klabel', 'kw', "'SQL_KEYWORD'")}
             WHEN kind = 'star' THEN {st("'SQL_KEYWORD_STAR'", "'*'", "'SQL_KEYWORD'")}
             WHEN kind = 'table' THEN {st("'TABLE_' || tok", 'tok', "'TABLE'")}
             WHEN kind = 'column' THEN {st(_COLUMN, 'cname', "'COLUMN'")} ELSE {null3} END""",
        f"""CASE WHEN kind = 'literal' THEN {st(value_node, f"replace(tok, {q1}, '')", "'VALUE'")}
             WHEN kind = 'column' AND ctable IS NOT NULL THEN {st("'TABLE_' || ctable", 'ctable', "'TABLE'")}
             ELSE {null3} END""")
    edge_arr = arr(
        f"""CASE WHEN kind = 'setop' AND depth = 0 THEN {st("'ROOT'", 'klabel', "'expression'")}
             WHEN lt = 'select' THEN {st("CASE WHEN depth = 0 THEN coalesce(top_setop, 'ROOT') ELSE last_any END",
                                          'klabel', "CASE WHEN depth = 0 THEN 'expression' ELSE 'this' END")}
             WHEN kind = 'clause' THEN {st('scope_select', 'klabel', 'lower(kw)')}
             WHEN kind = 'table' THEN {st("CASE WHEN prv = 'join' THEN prv_label ELSE scope_select END",
                                         "'TABLE_' || tok", "'FROM'")}
             ELSE {null3} END""",
        f"""CASE WHEN kind = 'literal' THEN {st('klabel', value_node, "'VALUE'")}
             WHEN kind = 'column' AND ctable IS NOT NULL THEN {st(_COLUMN, "'TABLE_' || ctable", "'belongs_to'")}
             ELSE {null3} END""")
    return node_arr, edge_arr


def graph_ctes(engine: str) -> str:
    """CTE chain over ``tk`` and ``trees(qid, src, dst, label)``: ``nodes`` and ``edges``."""
    d = _dialect(engine)
    node_arr, edge_arr = graph_arrays(engine)
    return f"""node_rows AS ({d['explode'].format(src='tk', arr=node_arr)}),
nodes AS (SELECT DISTINCT qid, a AS node_id, b AS val, c AS type FROM node_rows WHERE a IS NOT NULL),
edge_rows AS ({d['explode'].format(src='tk', arr=edge_arr)}),
edges AS (SELECT qid, a AS src, b AS dst, c AS label FROM edge_rows WHERE a IS NOT NULL AND b IS NOT NULL
          UNION SELECT qid, src, dst, label FROM trees WHERE src IS NOT NULL AND dst IS NOT NULL)"""


# --- operator-precedence trees -----------------------------------------------------------------

#: Label of the edge from parent entry {p} to child {k}; :func:`graphfold._side` says the same.
_SIDE = ("CASE WHEN {k}.kind = 'sub' THEN 'query' WHEN {k}.kind = 'column' OR {p}.kind IN ('clause', 'setop') THEN '"
         + CLAUSE_EDGE + "' WHEN {p}.kw = 'IN' AND {k}.pos > {p}.pos THEN 'expressions' "
         "WHEN {p}.kind IN ('agg', 'paren') OR {p}.kw IN ('NOT', 'NEG') OR {k}.pos < {p}.pos THEN 'this' ELSE 'expression' END")

#: The trees of :func:`graphfold.fold` for the oracle: each item with its neighbours of lower precedence. A bar's operands go where it goes.
TREE_JOINS = f"""it AS (SELECT qid, scope, pos, prec, take, kind, kw, {_NAME} AS name FROM tk WHERE take IS NOT NULL),
lp AS (SELECT x.qid, x.pos, max(o.pos) AS place FROM it x JOIN it o ON o.qid = x.qid AND o.scope = x.scope AND o.pos < x.pos
         AND (o.prec < x.prec OR o.take = 'prefix' AND o.prec = x.prec) WHERE x.take <> 'clause' GROUP BY x.qid, x.pos),
rp AS (SELECT x.qid, x.pos, min(o.pos) AS place FROM it x JOIN it o ON o.qid = x.qid AND o.scope = x.scope AND o.pos > x.pos
         AND o.take IN ('binary', 'bar', 'clause') AND o.prec <= x.prec WHERE x.take <> 'clause' GROUP BY x.qid, x.pos),
up AS (SELECT x.qid, x.pos, x.kind, x.name, x.take, x.pos AS own,
         CASE WHEN r.take <> 'clause' AND r.prec > l.prec THEN r.pos ELSE l.pos END AS parent
       FROM it x JOIN lp ON lp.qid = x.qid AND lp.pos = x.pos JOIN it l ON l.qid = x.qid AND l.pos = lp.place
       LEFT JOIN rp ON rp.qid = x.qid AND rp.pos = x.pos LEFT JOIN it r ON r.qid = x.qid AND r.pos = rp.place),
climb(qid, own, place) AS (
  SELECT qid, pos, parent FROM up WHERE take <> 'bar'
  UNION ALL SELECT c.qid, c.own, up.parent FROM climb c JOIN up ON up.qid = c.qid AND up.pos = c.place AND up.take = 'bar'),
trees AS (SELECT k.qid, p.name AS src, k.name AS dst, {_SIDE.format(p='p', k='k')} AS label
          FROM climb JOIN it k ON k.qid = climb.qid AND k.pos = climb.own
          JOIN it p ON p.qid = climb.qid AND p.pos = climb.place WHERE p.take <> 'bar')"""


def clean_for_graph(query):
    """Query text as lexed: post-processed, split operators joined, double quotes made single."""
    return T.double_to_single_quotes(T.join_split_ops(T.postprocess_sql(query)))


def catalog_names(columns: DataFrame) -> DataFrame:
    """``(table_name, column_name)`` in lower case of catalog columns, for the resolution of unqualified columns."""
    return columns.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()


#: Bytes of query text of a partition: its classified tokens, about a hundred times as many, sort in memory.
PART_BYTES = 2 << 20

#: Over ``tt`` and ``holders(column_name, tables)``: the tokens with column names and tables. The same resolution as
#: RESOLVE_CTES, by the names and SELECTs of each query instead of joins: all windows are within the query. Queries
#: without qid have no enclosing names.
SPARK_TK = """tu AS (SELECT *,
    collect_list(CASE WHEN lt = 'select' AND qid IS NOT NULL THEN named_struct('spos', pos, 'sdepth', depth) END)
      OVER (PARTITION BY qid) AS sels,
    collect_list(CASE WHEN qid IS NOT NULL AND (kind = 'table' OR kind = 'alias' AND atable IS NOT NULL)
                      THEN named_struct('scope', scope, 'sdepth', depth, 'npos', pos, 'name', lower(tok),
                                        'tbl', CASE WHEN kind = 'table' THEN tok ELSE atable END, 'kind', kind) END)
      OVER (PARTITION BY qid) AS names,
    CASE WHEN kind = 'column' AND qual IS NULL THEN lower(tok) END AS bare FROM tt),
tv AS (SELECT {hint}tu.*, CASE WHEN kind = 'column' THEN array_min(transform(
         filter(names, n -> n.scope > 0 AND n.scope < pos AND n.sdepth <= depth
                AND (n.name = lower(qual) OR qual IS NULL AND n.kind = 'table' AND array_contains(holders.tables, n.name))
                AND NOT exists(sels, o -> o.sdepth = n.sdepth AND o.spos > n.scope AND o.spos < pos)),
         n -> named_struct('up', -n.sdepth, 'npos', n.npos, 'tbl', n.tbl))).tbl END AS best
       FROM tu LEFT JOIN holders ON holders.column_name = tu.bare)
SELECT tv.*, CASE WHEN kind = 'column' AND qual IS NOT NULL THEN split_part(tok, '.', 2) ELSE tok END AS cname,
       CASE WHEN kind <> 'column' THEN NULL WHEN best IS NOT NULL THEN best
            WHEN qual IS NOT NULL THEN coalesce(any_table, qual)
            WHEN from_table IS NOT NULL THEN from_table WHEN low_table = high_table THEN low_table END AS ctable FROM tv"""


def spread_by_query(queries: DataFrame, qid: str, query: str) -> DataFrame:
    """``(qid, q)``: cleaned texts spread by qid over partitions of about ``PART_BYTES`` of text.

    The one shuffle of the graph moves texts, not tokens, and its partitions do not grow
    with the log, so the sorts over their tokens do not spill.
    """
    size = queries.agg(F.sum(F.octet_length(query))).first()[0] or 0
    n = max(queries.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return queries.select(F.col(qid).alias("qid"), clean_for_graph(F.col(query)).alias("q")).repartition(n, "qid")


def _holders(spark, catalog: DataFrame | None) -> tuple[DataFrame, bool]:
    """``(column_name, tables)`` of the catalog, and whether it may be broadcast."""
    if catalog is None:
        catalog = spark.createDataFrame([], "table_name string, column_name string")
    return broadcast_if_bounded(catalog.groupBy("column_name").agg(F.collect_set("table_name").alias("tables")))


def resolved_tokens(queries: DataFrame, catalog: DataFrame | None = None, qid: str = "qid",
                    query: str = "query") -> DataFrame:
    """``tk``: the classified tokens of every query, columns with their tables, spread by query.

    The catalog is broadcast if it is small, so the tokens stay where they are.
    """
    spark = queries.sparkSession
    src = spread_by_query(queries, qid, query)
    # a hint on a DataFrame is lost when a statement binds it
    holders, small = _holders(spark, catalog)
    resolve = SPARK_TK.replace("{hint}", "/*+ BROADCAST(holders) */ " if small else "")
    return spark.sql("WITH src AS (SELECT * FROM {src_df}), holders AS (SELECT * FROM {holders_df}), " + token_ctes("spark")
                     + ",\n" + resolve, src_df=src, holders_df=holders)


def graphs(queries: DataFrame, catalog: DataFrame | None = None, qid: str = "qid", query: str = "query",
           edges: bool = True) -> DataFrame:
    """``(qid, ns, es)``: the distinct nodes and edges of every query as the arrays of one row.

    Texts are spread by qid once and folded where they are (:mod:`graphfold`); a token is never a
    row. A small catalog goes along with the function, of a large one only what a text's tokens name.
    """
    spark = queries.sparkSession
    src = spread_by_query(queries, qid, query)
    held, small = _holders(spark, catalog)
    if small:
        known = {r["column_name"]: set(r["tables"]) for r in held.collect()}
    else:
        known = {}
        named = src.select("qid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("q", F.lit(LEX_RE), F.lit(0)), F.lower)))
                           .alias("column_name")).join(held, "column_name")
        named = named.groupBy("qid").agg(F.collect_list(F.struct("column_name", "tables")).alias("held"))
        src = src.join(named, "qid", "left")
    kind = graphfold.graph_type(src.schema["qid"].dataType.simpleString())
    return src.sortWithinPartitions("qid").mapInArrow(graphfold.folds(known, edges), kind)


def graph_nodes(made: DataFrame) -> DataFrame:
    return made.select("qid", F.explode("ns").alias("x")).select("qid", "x.*")


def graph_edges(made: DataFrame) -> DataFrame:
    return made.select("qid", F.explode("es").alias("x")).select("qid", "x.*")


def tables_columns(made: DataFrame) -> DataFrame:
    """``(qid, table_node, n_columns, columns)``: every table of a graph with the names of its columns, sorted.

    A table without columns in the query has an empty list. The edges are followed in the graph's row.
    """
    columns = ("array_sort(transform(filter(ns, c -> c.type = 'COLUMN' AND exists(es, e -> e.src = c.node_id "
               "AND e.dst = t.node_id AND e.label = 'belongs_to')), c -> c.val))")
    tables = f"transform(filter(ns, t -> t.type = 'TABLE'), t -> named_struct('node', t.node_id, 'columns', {columns}))"
    out = made.select("qid", F.explode_outer(F.expr(tables)).alias("x")).filter("x IS NOT NULL")
    return out.select("qid", F.col("x.node").alias("table_node"), F.size("x.columns").cast("bigint").alias("n_columns"), "x.columns")


def graph_query(queries: DataFrame, select: str, catalog: DataFrame | None = None, qid: str = "qid",
                query: str = "query") -> DataFrame:
    """``SELECT <select>`` over the tables ``tk``, ``nodes`` and ``edges`` of all queries.

    One of the tables is read straight from the texts; nodes and edges together are written once.
    """
    used = [t for t in ("nodes", "edges") if re.search(rf"\b{t}\b", select)]
    if not used:
        return queries.sparkSession.sql("WITH tk AS (SELECT * FROM {tk_df}) " + select,
                                        tk_df=resolved_tokens(queries, catalog, qid, query))
    if len(used) == 2:
        tables = dict(zip(("nodes_df", "edges_df"), graph_tables(queries, catalog, qid, query), strict=True))
    elif used == ["nodes"]:
        tables = {"nodes_df": graph_nodes(graphs(queries, catalog, qid, query, edges=False))}
    else:
        tables = {"edges_df": graph_edges(graphs(queries, catalog, qid, query))}
    ctes = ", ".join(f"{t[:-3]} AS (SELECT * FROM {{{t}}})" for t in tables)
    return queries.sparkSession.sql(f"WITH {ctes} {select}", **tables)


def duck_graph_query(src_sql: str, select: str) -> str:
    """The oracle's statement over a ``src(qid, q)`` subquery: own trees, the catalog from the registered views."""
    tables = ", ".join(f"'{t}'" for t in TABLES)
    gcat = f"""gcat AS (SELECT DISTINCT lower(table_name) AS table_name, lower(column_name) AS column_name
  FROM information_schema.columns WHERE table_name IN ({tables}))"""
    return ("WITH RECURSIVE src AS (" + src_sql + "), " + token_ctes("duckdb") + ",\n" + gcat + ",\n" + RESOLVE_CTES
            + ",\ntk AS (" + TK + "),\n" + TREE_JOINS + ",\n" + graph_ctes("duckdb") + "\n" + select)


def graph_tables(queries: DataFrame, catalog: DataFrame | None = None, qid: str = "qid",
                 query: str = "query") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every query, materialised once for their many consumers.

    The graphs are written in the cluster's checkpoint folder, one row each: downstream
    work then starts from short, recoverable lineage instead of re-reading the texts, and
    reads only the arrays it needs.
    """
    made = stored(graphs(queries, catalog, qid, query), "graphs")
    return graph_nodes(made), graph_edges(made)
