"""DuckDB SQL builders mirroring the Spark column expressions, for oracle statements."""

from __future__ import annotations

from shotloom.functions import text as T
from shotloom.functions.constants import LITERAL_RE
from shotloom.sources.catalog import LOGICAL_DBS
from shotloom.sources.tables import QLOG_SQL

WP = T.WORD_PUNCT_RE
W = T.WORD_RE
QLOG_CTE = f"qlog AS ({QLOG_SQL})"


def lit(s: str | None) -> str:
    """SQL string literal (standard quoting; newlines kept verbatim)."""
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def toks(e: str) -> str:
    return f"regexp_extract_all(coalesce({e}, ''), {lit(WP)})"


def sql_toks(e: str) -> str:
    return f"regexp_extract_all(lower(coalesce({e}, '')), {lit(WP)})"


def ntok(e: str) -> str:
    return f"CAST(len({toks(e)}) AS BIGINT)"


def nwords(e: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({e}, ''), {lit(W)})) AS BIGINT)"


def collapse_ws(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def cut_comment(e: str) -> str:
    return f"split_part({e}, '/*', 1)"


def strip_fences(e: str) -> str:
    c = f"regexp_replace(trim({e}), '^(SELECT )?```(sql)?\\s*', '')"
    return f"trim(regexp_replace({c}, '\\s*```$', ''))"


def ensure_select(e: str) -> str:
    return (f"CASE WHEN starts_with(lower({e}), 'select') OR starts_with(lower({e}), 'with') "
            f"THEN {e} ELSE 'SELECT ' || {e} END")


def postprocess(e: str) -> str:
    return ensure_select(strip_fences(f"trim({cut_comment(collapse_ws(e))})"))


def join_split_ops(e: str) -> str:
    return f"regexp_replace({e}, '([<>!])\\s+=', '\\1=', 'g')"


def double_to_single(e: str) -> str:
    return f"regexp_replace({e}, '\"([^\"]*)\"', '''\\1''', 'g')"


def cur_year(e: str) -> str:
    return f"regexp_replace({e}, '(?i)YEAR\\s*\\(\\s*CURDATE\\s*\\(\\s*\\)\\s*\\)\\s*', '2020', 'g')"


def n_sub(s: str, pat: str) -> str:
    return f"CAST((length({s}) - length(replace({s}, {lit(pat)}, ''))) / {len(pat)} AS BIGINT)"


def n_tok(tk: str, word: str) -> str:
    return f"CAST(len(list_filter({tk}, lambda x: x = {lit(word)})) AS BIGINT)"


def clause(s: str, start: str, stops: tuple[str, ...]) -> str:
    at = f"strpos({s}, {lit(start)})"
    e = f"CASE WHEN {at} > 0 THEN substr({s}, {at} + {len(start)}) ELSE '' END"
    for st in stops:
        e = f"split_part({e}, {lit(st)}, 1)"
    return e


def uniform(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"


def catalog_ctes() -> str:
    """CTEs ``cat`` (columns with col_idx, kinds), ``pk`` and ``fk`` from information_schema."""
    rows = ", ".join(f"({lit(t)}, {lit(db)}, {i})" for db, ts in LOGICAL_DBS.items() for i, t in enumerate(ts))
    return f"""dbs(table_name, db_id, table_idx) AS (VALUES {rows}),
cols0 AS (SELECT DISTINCT d.db_id, CAST(d.table_idx AS BIGINT) AS table_idx, c.table_name,
                 CAST(c.ordinal_position AS BIGINT) AS ordinal, c.column_name, c.data_type
          FROM information_schema.columns c JOIN dbs d ON c.table_name = d.table_name),
cat AS (SELECT *, CAST(row_number() OVER (PARTITION BY db_id ORDER BY table_idx, ordinal) AS BIGINT) AS col_idx,
   CASE WHEN kind IN ('integer', 'real') THEN 'number' WHEN kind = 'text' THEN 'text' WHEN kind = 'time' THEN 'time'
        WHEN kind = 'boolean' THEN 'boolean' ELSE 'others' END AS column_type,
   CASE WHEN kind = 'integer' THEN 'INTEGER' WHEN kind = 'real' THEN 'REAL' WHEN kind = 'text' THEN 'TEXT'
        WHEN kind = 'time' THEN 'TIMESTAMP' WHEN kind = 'boolean' THEN 'BOOLEAN' ELSE 'BLOB' END AS ddl_type,
   CASE WHEN regexp_matches(column_name, '^[a-z]_') THEN substr(column_name, 3) ELSE column_name END AS stem
   FROM (SELECT *, CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer'
          WHEN data_type IN ('FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'real'
          WHEN data_type = 'VARCHAR' THEN 'text'
          WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time'
          WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'other' END AS kind FROM cols0)),
pk AS (SELECT db_id, table_idx, table_name, column_name, col_idx, stem FROM cat
       WHERE ordinal = 1 AND (column_name LIKE '%key' OR column_name LIKE '%id')),
fk AS (SELECT c.db_id, c.table_name, c.column_name, p.table_name AS ref_table, p.column_name AS ref_column, c.col_idx
       FROM cat c JOIN pk p ON c.db_id = p.db_id AND c.stem = p.stem
       WHERE c.table_name <> p.table_name AND (c.ordinal <> 1 OR p.table_idx < c.table_idx)),
schema_t AS (SELECT db_id, string_agg(ddl, chr(10) || chr(10) ORDER BY table_idx) AS schema_text FROM (
   SELECT db_id, table_idx, 'CREATE TABLE ' || table_name || ' (' || chr(10)
          || string_agg('  ' || column_name || ' ' || ddl_type, ',' || chr(10) ORDER BY ordinal) || chr(10) || ')' AS ddl
   FROM cat GROUP BY db_id, table_idx, table_name) GROUP BY db_id),
flat AS (SELECT DISTINCT db_id, table_idx, table_name, CAST(0 AS BIGINT) AS col_idx, '*' AS column_name, 'text' AS column_type FROM cat
         UNION ALL SELECT db_id, table_idx, table_name, col_idx, column_name, column_type FROM cat),
rendered AS (SELECT d.db_id, coalesce(f.fields, '') AS fields,
     '[' || coalesce(k.fk, '') || ']' AS fk_list, '[' || coalesce(p.pk, '') || ']' AS pk_list
   FROM (SELECT DISTINCT db_id FROM cat) d
   LEFT JOIN (SELECT db_id, string_agg(line, '' ORDER BY table_name) AS fields FROM (
        SELECT db_id, table_name, 'Table ' || table_name || ', columns = ['
               || string_agg(column_name, ',' ORDER BY col_idx) || ']' || chr(10) AS line
        FROM flat GROUP BY db_id, table_name) GROUP BY db_id) f ON f.db_id = d.db_id
   LEFT JOIN (SELECT db_id, string_agg(table_name || '.' || column_name || ' = ' || ref_table || '.' || ref_column, ','
              ORDER BY col_idx) AS fk FROM fk GROUP BY db_id) k ON k.db_id = d.db_id
   LEFT JOIN (SELECT db_id, string_agg(table_name || '.' || column_name, ',' ORDER BY col_idx) AS pk
              FROM pk GROUP BY db_id) p ON p.db_id = d.db_id)"""


# Scalar columns of the driver tables by type (t text, i integer, d double, s timestamp).
SCALAR_COLUMNS = {
    "region": "r_regionkey i, r_name t",
    "nation": "n_nationkey i, n_name t, n_regionkey i",
    "customer": "c_custkey i, c_name t, c_nationkey i, c_acctbal d, c_mktsegment t",
    "supplier": "s_suppkey i, s_name t, s_nationkey i, s_acctbal d",
    "part": "p_partkey i, p_name t, p_brand t, p_type t, p_size i, p_retailprice d",
    "orders": "o_orderkey i, o_custkey i, o_orderstatus t, o_totalprice d, o_orderdate s, o_orderpriority t",
    "lineitem": "l_orderkey i, l_partkey i, l_suppkey i, l_linenumber i, l_quantity d, l_extendedprice d, l_discount d, "
                "l_tax d, l_returnflag t, l_linestatus t, l_shipdate s",
    "events": "event_id i, ts s, user_id i, event_type t, value d, props t",
    "documents": "doc_id i, text t, lang t, source t, n_chars i",
    "embeddings": "vec_id i, label i",
    "pages": "page_id i, url t, html t",
    "benchmark": "item_id i, text t",
    "labels": "doc_id i, quality i, toxic i",
    "conversations": "conv_id i, turn i, role t, text t",
}


def content_index_cte() -> str:
    """``ci``: distinct values of every scalar column of every table as engine-independent text."""
    text = {"t": "{c}", "i": "CAST({c} AS VARCHAR)", "s": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
            "d": "coalesce(regexp_replace(CAST(TRY_CAST({c} AS DECIMAL(38,6)) AS VARCHAR), '\\.?0+$', ''), CAST({c} AS VARCHAR))"}
    kind = {"t": "text", "i": "number", "d": "number", "s": "time"}
    parts = []
    for db, ts in LOGICAL_DBS.items():
        for t in ts:
            for column in SCALAR_COLUMNS[t].split(", "):
                c, k = column.split(" ")
                parts.append(f"SELECT DISTINCT {lit(db)} AS db_id, {lit(t)} AS table_name, {lit(c)} AS column_name, "
                             f"{text[k].format(c=f'{t}.{c}')} AS value, {lit(kind[k])} AS value_type FROM {t} WHERE {t}.{c} IS NOT NULL")
    return "ci AS (" + "\nUNION ALL ".join(parts) + ")"


def log_databases_cte() -> str:
    """``ldb(db_id, content_db)``: the catalog database whose tables a log id's queries name most."""
    rows = ", ".join(f"({lit(db)}, {lit(t)})" for db, ts in LOGICAL_DBS.items() for t in ts)
    return f"""ltab(content_db, word) AS (VALUES {rows}),
lw AS (SELECT db_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z_][a-z0-9_]*'))) AS word FROM qlog),
lc AS (SELECT db_id, content_db, count(*) AS n FROM lw JOIN ltab USING (word) GROUP BY ALL),
ldb AS (SELECT db_id, content_db FROM (
  SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY n DESC, content_db) AS k FROM lc) WHERE k = 1)"""


LIT_RE_SQL = lit(LITERAL_RE)
