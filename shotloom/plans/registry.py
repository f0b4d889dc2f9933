"""Registered queries ``(spark, sf_dir) -> DataFrame`` and their DuckDB oracle SQL.

Every query reads whole driver tables (or views Spark derives from them). Column
names and types are aligned with the oracle: ids and counts BIGINT, scores
rounded DOUBLE, text STRING.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.functions.hashing import uniform_sql
from shotloom.operators import retrieve as R
from shotloom.session import checkpoint_dir
from shotloom.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Steps that read table schemas but no rows: tested like the queries, not registered as such.
SCHEMA_STEPS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCHEMA_ORACLE: dict[str, str] = {}

K = 5
SEED = 1234

WP = T.WORD_PUNCT_RE
QLOG_CTE = f"qlog AS ({S.QLOG_SQL})"


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def schema_step(name: str, oracle: str):
    def deco(fn):
        SCHEMA_STEPS[name], SCHEMA_ORACLE[name] = fn, oracle
        return fn
    return deco


def _toks_sql(expr: str) -> str:
    return f"regexp_extract_all(coalesce({expr}, ''), '{WP}')"


def _sql_toks_sql(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '{WP}')"


# --- retrieval ---------------------------------------------------------------------

def _targets_pool(spark, sf_dir):
    t = S.targets(spark, sf_dir).withColumn("toks", T.tokens("question"))
    p = S.pool(spark, sf_dir).withColumn("toks", T.tokens("question"))
    return t, p


@query("retrieve_jaccard", oracle=f"""
WITH t AS (SELECT item_id AS target_id, list_distinct({_toks_sql('text')}) AS ts FROM benchmark),
p AS (SELECT doc_id AS demo_id, list_distinct({_toks_sql('text')}) AS ps FROM documents),
pairs AS (SELECT target_id, demo_id, len(list_intersect(ts, ps)) AS inter, len(ts) AS na, len(ps) AS nb FROM t, p),
scored AS (SELECT target_id, demo_id,
   CASE WHEN inter = 0 OR na + nb - inter = 0 THEN 0.0 ELSE inter::DOUBLE / (na + nb - inter) END AS s FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC, demo_id) AS rank FROM scored)
SELECT target_id, demo_id, round(s, 6) AS score, rank FROM ranked WHERE rank <= {K}
""")
def q_retrieve_jaccard(spark, sf_dir):
    t, p = _targets_pool(spark, sf_dir)
    return R.jaccard(t, p, K)


@query("retrieve_first_k", oracle=f"""
WITH f AS (SELECT doc_id AS demo_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents)
SELECT b.item_id AS target_id, f.demo_id, f.rank FROM benchmark b, f WHERE f.rank <= {K}
""")
def q_retrieve_first_k(spark, sf_dir):
    return R.first_k(S.targets(spark, sf_dir), S.pool(spark, sf_dir), K)


@query("retrieve_random", oracle=f"""
WITH t AS (SELECT item_id AS target_id, {uniform_sql(str(SEED), "'t'", 'item_id')} AS s FROM benchmark),
p AS (SELECT doc_id AS demo_id, {uniform_sql(str(SEED), 'doc_id')} AS u FROM documents),
pairs AS (SELECT target_id, demo_id, CASE WHEN u - s < 0 THEN u - s + 1.0 ELSE u - s END AS h FROM t, p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY h, demo_id) AS rank FROM pairs)
SELECT target_id, demo_id, round(h, 9) AS score, rank FROM ranked WHERE rank <= {K}
""")
def q_retrieve_random(spark, sf_dir):
    return R.seeded_sample(S.targets(spark, sf_dir), S.pool(spark, sf_dir), K, SEED)


_CLASS_SQL = """CASE WHEN list_has_any(tk, ['intersect', 'union', 'except']) THEN 'conjunction'
  WHEN NOT list_contains(tk, 'join') AND (list_has_any(tk, ['max', 'min', 'count', 'sum', 'avg', 'having'])
       OR (' ' || array_to_string(tk, ' ') || ' ') LIKE '% group by %') THEN 'aggr'
  WHEN list_contains(tk, 'join') AND NOT (list_has_any(tk, ['max', 'min', 'count', 'sum', 'avg', 'having'])
       OR (' ' || array_to_string(tk, ' ') || ' ') LIKE '% group by %') THEN 'join'
  ELSE 'easy' END"""


def _qlog_classed(spark, sf_dir):
    q = S.qlog(spark, sf_dir)
    return q.withColumn("cls", R.structure_class(T.sql_tokens("query")))


@query("structure_class", oracle=f"""
WITH {QLOG_CTE}, tq AS (SELECT qid, {_sql_toks_sql('query')} AS tk FROM qlog)
SELECT qid, {_CLASS_SQL} AS cls FROM tq
""")
def q_structure_class(spark, sf_dir):
    return _qlog_classed(spark, sf_dir).select("qid", "cls")


@query("retrieve_class", oracle=f"""
WITH {QLOG_CTE}, tq AS (SELECT qid, {_sql_toks_sql('query')} AS tk FROM qlog),
c AS (SELECT qid, {_CLASS_SQL} AS cls FROM tq),
t AS (SELECT qid AS target_id, cls, {uniform_sql(str(SEED), "'t'", 'qid')} AS s FROM c),
p AS (SELECT qid AS demo_id, cls, {uniform_sql(str(SEED), 'qid')} AS u FROM c),
pairs AS (SELECT target_id, demo_id, CASE WHEN u - s < 0 THEN u - s + 1.0 ELSE u - s END AS h
          FROM t JOIN p USING (cls) WHERE target_id <> demo_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY h, demo_id) AS rank FROM pairs)
SELECT target_id, demo_id, round(h, 9) AS score, rank FROM ranked WHERE rank <= {K}
""")
def q_retrieve_class(spark, sf_dir):
    c = _qlog_classed(spark, sf_dir).select("qid", "cls")
    return R.seeded_sample(c, c, K, SEED, target_id="qid", pool_id="qid",
                           target_group="cls", pool_group="cls", exclude_self=True)


def _dot_oracle(normalize: bool) -> str:
    vec = "embedding::DOUBLE[]"
    if normalize:
        score = (f"CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0 ELSE "
                 f"list_dot_product(a.v, b.v) / (a.nrm * b.nrm) END")
    else:
        score = "list_dot_product(a.v, b.v)"
    return f"""
WITH e AS (SELECT vec_id, {vec} AS v, sqrt(list_dot_product({vec}, {vec})) AS nrm FROM embeddings),
pairs AS (SELECT a.vec_id AS target_id, b.vec_id AS demo_id, {score} AS s
          FROM e a, e b WHERE a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY s DESC, demo_id) AS rank FROM pairs)
SELECT target_id, demo_id, round(s, 5) AS score, rank FROM ranked WHERE rank <= {K}
"""


@query("retrieve_dot", oracle=_dot_oracle(False))
def q_retrieve_dot(spark, sf_dir):
    e = S.load(spark, sf_dir, "embeddings")
    return R.dot_topk(e, e, K, target_id="vec_id", target_vec="embedding",
                      pool_id="vec_id", pool_vec="embedding", exclude_self=True)


@query("retrieve_cosine", oracle=_dot_oracle(True))
def q_retrieve_cosine(spark, sf_dir):
    e = S.load(spark, sf_dir, "embeddings")
    return R.dot_topk(e, e, K, target_id="vec_id", target_vec="embedding",
                      pool_id="vec_id", pool_vec="embedding", normalize=True, exclude_self=True)


# --- preparation and filters ----------------------------------------------------------

from shotloom.plans import duck as D  # noqa: E402
from shotloom.operators import prep as P  # noqa: E402
from shotloom.operators import complexity as H  # noqa: E402
from shotloom.operators import prompt as PR  # noqa: E402
from shotloom.operators import correct as EC  # noqa: E402
from shotloom.operators import content as V  # noqa: E402
from shotloom.operators.common import dense_index, join_small_side, stored  # noqa: E402
from shotloom.sources import catalog as CAT  # noqa: E402


@query("assign_idx", oracle="""
SELECT lang AS split, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS idx
FROM documents
""")
def q_assign_idx(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents").select(F.col("lang").alias("split"), "doc_id")
    return P.assign_idx(d, split="split", pos="doc_id").select("split", "doc_id", "idx")


@query("db_paths", oracle="""
SELECT DISTINCT lang AS split, source AS db_id,
       concat_ws('/', 'datasets', lang, 'database', source, source || '.sqlite') AS db_path
FROM documents
""")
def q_db_paths(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("source").alias("db_id"))
    return P.db_paths(d)


@query("first_n", oracle="""
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, doc_id, n_chars
               FROM documents) WHERE idx < 100
""")
def q_first_n(spark, sf_dir):
    d = dense_index(S.load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [], ["doc_id"])
    return P.first_n(d, 100).select("idx", "doc_id", "n_chars")


@query("valid_indices", oracle="""
WITH l AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos FROM labels)
SELECT l.pos, d.doc_id, d.lang FROM documents d JOIN l ON d.doc_id = l.doc_id
""")
def q_valid_indices(spark, sf_dir):
    listed = dense_index(S.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx")), [], ["idx"], out="pos")
    d = S.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    return P.keep_listed(d, listed).select("pos", F.col("idx").alias("doc_id"), "lang")


@query("overlay_preliminary", oracle=f"""
WITH {D.QLOG_CTE}
SELECT qid, {D.postprocess('query')} AS query, query AS gold_query
FROM qlog
""")
def q_overlay_preliminary(spark, sf_dir):
    q = S.qlog(spark, sf_dir)
    prelim = q.select("qid", T.postprocess_sql(F.col("query")).alias("prelim_query"))
    return P.overlay_preliminary(q.select("qid", "query"), prelim, ["qid"]).select("qid", "query", "gold_query")


@query("tokenize", oracle=f"""
WITH {D.QLOG_CTE}, t AS (SELECT qid, {D.toks('question')} AS qt, {D.sql_toks('query')} AS st FROM qlog)
SELECT qid, CAST(len(qt) AS BIGINT) AS n_question_toks, CAST(len(st) AS BIGINT) AS n_query_toks,
       array_to_string(qt, ' ') AS question_toks, array_to_string(st, ' ') AS query_toks FROM t
""")
def q_tokenize(spark, sf_dir):
    q = S.qlog(spark, sf_dir).select("qid", T.tokens("question").alias("qt"), T.sql_tokens("query").alias("st"))
    return q.select("qid", F.size("qt").cast("bigint").alias("n_question_toks"),
                    F.size("st").cast("bigint").alias("n_query_toks"),
                    F.array_join("qt", " ").alias("question_toks"), F.array_join("st", " ").alias("query_toks"))


@query("token_count", oracle=f"""
SELECT doc_id, {D.ntok('text')} AS n_tokens, {D.nwords('text')} AS n_words FROM documents
""")
def q_token_count(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    return d.select("doc_id", T.token_count("text").alias("n_tokens"),
                    F.size(T.words("text")).cast("bigint").alias("n_words"))


@query("clean_sql", oracle=f"""
WITH {D.QLOG_CTE}
SELECT qid, {D.cur_year('query')} AS cur_year, {D.join_split_ops('query')} AS fixed_ops,
       {D.double_to_single('query')} AS quoted,
       {D.join_split_ops(D.postprocess(D.cur_year('query')))} AS cleaned
FROM qlog
""")
def q_clean_sql(spark, sf_dir):
    q = S.qlog(spark, sf_dir)
    return q.select("qid", T.replace_cur_year("query").alias("cur_year"),
                    T.join_split_ops("query").alias("fixed_ops"),
                    T.double_to_single_quotes("query").alias("quoted"),
                    T.join_split_ops(T.postprocess_sql(T.replace_cur_year("query"))).alias("cleaned"))


def _shape_sql() -> str:
    """Structure counts by collapsing parentheses from the inside out (no token automaton)."""
    j = "s"
    for _ in range(4):  # the log nests two deep
        j = f"regexp_replace({j}, '\\( select [^()]*\\)', 'subquery', 'g')"
        j = f"regexp_replace({j}, '\\(([^()]*)\\)', '«\\1»', 'g')"
    stops = (" from ", " where ", " group by ", " having ", " order by ", " limit ")
    parts = {"sel": (" select ", stops), "frm": (" from ", stops[1:]), "whr": (" where ", stops[2:]),
             "grp": (" group by ", stops[3:]), "hav": (" having ", stops[4:]), "ord": (" order by ", stops[5:])}
    clauses = ",\n  ".join(f"string_split(trim({D.clause('o', a, z)}), ' ') AS {n}" for n, (a, z) in parts.items())

    def n(words: str, *lists: str) -> str:
        return f"CAST(len(list_filter({' || '.join(lists)}, lambda x: x IN ({words}))) AS BIGINT)"

    def commas(c: str) -> str:
        return f"CAST(len(string_split(regexp_replace(array_to_string({c}, ' '), '«[^«»]*»', '', 'g'), ',')) AS BIGINT)"

    def full(c: str) -> str:
        return f"(array_to_string({c}, '') <> '')"

    aggs = " + ".join(f"CAST(len(string_split(' ' || array_to_string(sel || ['|'] || grp || ['|'] || ord, ' '), ' {w} «')) - 1 AS BIGINT)"
                      for w in ("max", "min", "count", "sum", "avg"))
    cleaned = f"regexp_replace({D.join_split_ops(D.postprocess('query'))}, {D.LIT_RE_SQL}, ' value ', 'g')"
    return f"""
WITH {D.QLOG_CTE},
t0 AS (SELECT qid, {D.sql_toks(cleaned)} AS tk FROM qlog),
t1 AS (SELECT qid, tk, ' ' || array_to_string(tk, ' ') || ' ' AS s FROM t0),
t2 AS (SELECT qid, tk, {j} AS f FROM t1),
t3 AS (SELECT qid, tk, regexp_matches(f, ' (intersect|union|except) ') AS so,
              regexp_replace(f, ' (intersect|union|except) .*$', ' ') AS o FROM t2),
t AS (SELECT qid, tk, so, o,
  {clauses} FROM t3),
sh AS (SELECT qid,
  CAST({full('whr')} AS BIGINT) AS n_where, CAST({full('grp')} AS BIGINT) AS n_group,
  CAST({full('ord')} AS BIGINT) AS n_order, CAST(contains(o, ' limit ') AS BIGINT) AS n_limit,
  {n("'join'", 'frm')} + {commas('frm')} - 1 AS n_join,
  {n("'or'", 'frm', 'whr', 'hav')} AS n_or, {n("'like'", 'frm', 'whr', 'hav')} AS n_like,
  {n("'subquery'", 'whr', 'hav')} AS n_nested, CAST(so AS BIGINT) AS n_setop,
  {aggs} + {n("'not'", 'whr', 'hav')} AS n_agg,
  {D.n_tok('tk', 'select')} AS n_select,
  {commas('sel')} AS n_select_cols,
  CASE WHEN {full('whr')} THEN {n("'and', 'or'", 'whr')} + 1 - {n("'between'", 'whr')} ELSE 0 END AS n_where_conds,
  CASE WHEN {full('grp')} THEN {commas('grp')} ELSE 0 END AS n_group_cols
  FROM t),
cx AS (SELECT *, CAST((n_where > 0)::INT + (n_group > 0)::INT + (n_order > 0)::INT + (n_limit > 0)::INT
                      + n_join + n_or + n_like AS BIGINT) AS comp1,
              CAST(n_nested + n_setop AS BIGINT) AS comp2,
              CAST((n_agg > 1)::INT + (n_select_cols > 1)::INT + (n_where_conds > 1)::INT + (n_group_cols > 1)::INT AS BIGINT) AS others
       FROM sh)
SELECT *, CASE WHEN comp1 <= 1 AND others = 0 AND comp2 = 0 THEN 'easy'
  WHEN (others <= 2 AND comp1 <= 1 AND comp2 = 0) OR (comp1 <= 2 AND others < 2 AND comp2 = 0) THEN 'medium'
  WHEN (others > 2 AND comp1 <= 2 AND comp2 = 0) OR (comp1 > 2 AND comp1 <= 3 AND others <= 2 AND comp2 = 0)
       OR (comp1 <= 1 AND others = 0 AND comp2 <= 1) THEN 'hard'
  ELSE 'extra' END AS hardness FROM cx
"""


@query("complexity", oracle=_shape_sql())
def q_complexity(spark, sf_dir):
    q = S.qlog(spark, sf_dir).select("qid", "query")
    return H.complexity(H.sql_shape(q)).drop("query")


# --- tokens, costs, packing ---------------------------------------------------------------

_CHAT_SQL = f"""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
  CAST(sum(4 + len({D.toks('role')}) + len({D.toks('text')})) + 2 AS BIGINT) AS n_tokens
FROM conversations GROUP BY conv_id"""


@query("chat_tokens", oracle=_CHAT_SQL)
def q_chat_tokens(spark, sf_dir):
    return PR.chat_tokens(S.load(spark, sf_dir, "conversations"))


COST_MODELS = ["gpt-4", "gpt-3.5-turbo-0125", "unknown-model"]


@query("prompt_cost", oracle=f"""
WITH c AS ({_CHAT_SQL}),
tot AS (SELECT CAST(count(*) AS BIGINT) AS n_prompts, CAST(sum(n_tokens) AS BIGINT) AS total_tokens FROM c),
m(model, price) AS (VALUES ('gpt-4', 0.03::DOUBLE), ('gpt-3.5-turbo-0125', 0.0005::DOUBLE), ('unknown-model', NULL::DOUBLE))
SELECT m.model, tot.n_prompts, tot.total_tokens, round(tot.total_tokens * m.price / 1000.0, 6) AS total_cost
FROM tot, m
""")
def q_prompt_cost(spark, sf_dir):
    return PR.cost_report(PR.chat_tokens(S.load(spark, sf_dir, "conversations")), COST_MODELS)


PACK_BUDGET = 512
_FLAT_A, _FLAT_REST = "### Answer the following question: ", "\n"


@query("pack_demos", oracle=f"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT u.conv_id, u.turn, {D.ntok("'### Answer the following question: ' || coalesce(u.text, '') || chr(10) || coalesce(a.text, '')")} AS cost
      FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
w AS (SELECT conv_id, cost, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos,
             CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
      FROM p),
f AS (SELECT *, {D.ntok("'### Some example pairs of question and corresponding SQL query are provided based on similar problems:'")} AS fx,
             {D.ntok("chr(10) || chr(10)")} AS sep FROM w)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_pairs,
  CAST(sum(CASE WHEN fx + cum + pos * sep <= {PACK_BUDGET} THEN 1 ELSE 0 END) AS BIGINT) AS n_section,
  CAST(sum(CASE WHEN fx + cum + (pos + 1) * sep <= {PACK_BUDGET} THEN 1 ELSE 0 END) AS BIGINT) AS n_sep_each,
  CAST(sum(CASE WHEN cum + pos * sep <= {PACK_BUDGET} THEN 1 ELSE 0 END) AS BIGINT) AS n_flat,
  CAST(coalesce(sum(CASE WHEN fx + cum + pos * sep <= {PACK_BUDGET} THEN cost END), 0) AS BIGINT) AS packed_tokens
FROM f GROUP BY conv_id
""")
def q_pack_demos(spark, sf_dir):
    from shotloom.functions.constants import TEMPLATES
    from shotloom.operators.common import ordered_prefix
    tpl = TEMPLATES["template_option_1"]
    c = S.load(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("a"))
    pairs = u.join(a, ["conv_id", "turn"])
    pairs = pairs.withColumn("cost", T.token_count(PR.format_demo(tpl["demo_format"], F.col("q"), F.col("a"))))
    d = ordered_prefix(pairs, ["conv_id"], ["turn"], value=F.col("cost"))
    fx = T.token_count(F.lit(tpl["demo_prefix"]))
    sep = T.token_count(F.lit(tpl["demo_sep"]))
    pos, cum = F.col("_pos"), F.col("_cum")
    flag = lambda mode: F.when(PR.packed_cost(mode, pos, cum, sep, fx) <= PACK_BUDGET, 1).otherwise(0)
    return d.groupBy("conv_id").agg(
        F.count("*").cast("bigint").alias("n_pairs"),
        F.sum(flag("section")).cast("bigint").alias("n_section"),
        F.sum(flag("sep_each")).cast("bigint").alias("n_sep_each"),
        F.sum(flag("flat")).cast("bigint").alias("n_flat"),
        F.coalesce(F.sum(F.when(PR.packed_cost("section", pos, cum, sep, fx) <= PACK_BUDGET, F.col("cost"))),
                   F.lit(0)).cast("bigint").alias("packed_tokens"))


# --- catalog and correction prompts ----------------------------------------------------------

@schema_step("catalog_flatten", oracle=f"""
WITH {D.catalog_ctes()}
SELECT db_id, table_name, col_idx, column_name, column_type FROM flat
""")
def q_catalog_flatten(spark, sf_dir):
    return CAT.flatten(CAT.catalog_columns(spark, sf_dir)).select(
        "db_id", "table_name", "col_idx", "column_name", "column_type")


@schema_step("schema_text", oracle=f"""
WITH {D.catalog_ctes()}
SELECT db_id, schema_text FROM schema_t
""")
def q_schema_text(spark, sf_dir):
    return CAT.schema_text(CAT.catalog_columns(spark, sf_dir))


@schema_step("catalog_render", oracle=f"""
WITH {D.catalog_ctes()}
SELECT db_id, fields, fk_list, pk_list FROM rendered
""")
def q_catalog_render(spark, sf_dir):
    return EC.render_catalog(CAT.catalog_columns(spark, sf_dir))


RULES = [1, 2, 3]


def _per_log_db(log: DataFrame, catalogs: DataFrame) -> DataFrame:
    """The catalog text of every database of the log; its databases all have the star tables."""
    star = catalogs.filter(F.col("db_id") == "star")
    rest = [c for c in catalogs.columns if c != "db_id"]
    own = star.select(F.struct(*rest)).scalar()
    return log.select("db_id").distinct().select("db_id", own.alias("_c")).select("db_id", *[F.col("_c")[c].alias(c) for c in rest])


def _qlog_prev(spark, sf_dir):
    """Previous responses: the query log's SQL after post-processing."""
    q = S.qlog(spark, sf_dir)
    return q.select("qid", "question", "db_id", T.postprocess_sql(F.col("query")).alias("sql"))


@query("correction_prompt", oracle=f"""
WITH {D.QLOG_CTE}, {D.catalog_ctes()},
r AS (SELECT qid, question, 'star' AS db_id, {D.postprocess('query')} AS sql FROM qlog)
SELECT r.qid, {D.lit(EC.rule_block(RULES))} || x.fields || 'Foreign_keys = ' || x.fk_list || chr(10)
       || 'Primary_keys = ' || x.pk_list || chr(10) || '#### Question: ' || r.question
       || chr(10) || '#### SQLite SQL QUERY' || chr(10) || r.sql || chr(10) || '#### SQLite FIXED SQL QUERY' || chr(10) || 'SELECT' AS prompt
FROM r JOIN rendered x ON x.db_id = r.db_id
""")
def q_correction_prompt(spark, sf_dir):
    return _correction_prompts(spark, sf_dir).select("qid", "prompt")


def _correction_prompts(spark, sf_dir):
    rendered = EC.render_catalog(CAT.catalog_columns(spark, sf_dir))
    log = _qlog_prev(spark, sf_dir)
    return EC.catalog_prompt(log, _per_log_db(log, rendered), RULES)


@query("correction_prompt_schema", oracle=f"""
WITH {D.QLOG_CTE}, {D.catalog_ctes()},
r AS (SELECT qid, question, 'star' AS db_id, {D.postprocess('query')} AS sql FROM qlog)
SELECT r.qid, {D.lit(EC.rule_block(RULES))} || '#### Table Schema:' || chr(10) || s.schema_text || chr(10) || chr(10)
       || '#### Question:' || chr(10) || r.question || chr(10) || '#### SQLite SQL QUERY:' || chr(10) || r.sql
       || chr(10) || chr(10) || '#### SQLite FIXED SQL QUERY' || chr(10) || 'SELECT' AS prompt
FROM r JOIN schema_t s ON s.db_id = r.db_id
""")
def q_correction_prompt_schema(spark, sf_dir):
    schemas = CAT.schema_text(CAT.catalog_columns(spark, sf_dir))
    log = _qlog_prev(spark, sf_dir)
    return EC.schema_prompt(log, _per_log_db(log, schemas), RULES).select("qid", "prompt")


# --- content index and literal repair ---------------------------------------------------------

def _content(spark, sf_dir):
    return V.content_index(spark, sf_dir, CAT.LOGICAL_DBS)


@query("content_index", oracle=f"WITH {D.content_index_cte()} SELECT DISTINCT * FROM ci")
def q_content_index(spark, sf_dir):
    return _content(spark, sf_dir)


@query("db_values", oracle=f"WITH {D.content_index_cte()} SELECT DISTINCT db_id, value FROM ci")
def q_db_values(spark, sf_dir):
    return V.db_values(_content(spark, sf_dir))


@query("value_variants", oracle=f"""
WITH {D.content_index_cte()}, v AS (SELECT DISTINCT db_id, value FROM ci WHERE value_type = 'text')
SELECT db_id, lower(trim(value)) AS key, min(value) AS variant, CAST(count(*) AS BIGINT) AS n_variants
FROM v GROUP BY db_id, lower(trim(value))
""")
def q_value_variants(spark, sf_dir):
    return V.value_variants(V.db_values(_content(spark, sf_dir).filter("value_type = 'text'")))


@query("log_databases", oracle=f"WITH {D.QLOG_CTE}, {D.log_databases_cte()} SELECT * FROM ldb")
def q_log_databases(spark, sf_dir):
    return V.log_databases(S.qlog(spark, sf_dir), CAT.catalog_columns(spark, sf_dir))


_REPAIR_SQL = f"""
WITH {D.QLOG_CTE}, {D.content_index_cte()}, {D.log_databases_cte()},
vals AS (SELECT DISTINCT db_id, value FROM ci WHERE value_type = 'text'),
var AS (SELECT db_id, lower(trim(value)) AS key, min(value) AS variant FROM vals GROUP BY db_id, lower(trim(value))),
q AS (SELECT qid, qlog.db_id, ldb.content_db, query FROM qlog LEFT JOIN ldb ON ldb.db_id = qlog.db_id),
l AS (SELECT qid, content_db, unnest(regexp_extract_all(query, {D.LIT_RE_SQL}, 1)) AS lit,
             generate_subscripts(regexp_extract_all(query, {D.LIT_RE_SQL}, 1), 1) AS pos FROM q),
r AS (SELECT l.qid, l.pos, l.lit,
        CASE WHEN v.value IS NOT NULL THEN l.lit WHEN w.variant IS NOT NULL THEN w.variant ELSE l.lit END AS new
      FROM l LEFT JOIN vals v ON v.db_id = l.content_db AND v.value = l.lit
             LEFT JOIN var w ON w.db_id = l.content_db AND w.key = lower(trim(l.lit))),
agg AS (SELECT qid, list(new ORDER BY pos) AS news, max(CASE WHEN new <> lit THEN 1 ELSE 0 END) AS chg FROM r GROUP BY qid),
rep AS (SELECT q.qid, q.db_id,
  CASE WHEN news IS NULL THEN q.query ELSE
    array_to_string(list_transform(range(len(news)), lambda i: string_split_regex(q.query, {D.LIT_RE_SQL})[i + 1] || chr(39) || news[i + 1] || chr(39)), '')
    || string_split_regex(q.query, {D.LIT_RE_SQL})[len(news) + 1] END AS repaired,
  coalesce(chg, 0) = 1 AS changed
FROM q LEFT JOIN agg ON agg.qid = q.qid)"""


def _repaired(spark, sf_dir):
    log = stored(S.qlog(spark, sf_dir).select("qid", "db_id", "query"), "log")
    means = stored(V.log_databases(log, CAT.catalog_columns(spark, sf_dir)), "log-databases")
    rows = join_small_side(log, means, ["db_id"], F.col("qid"), how="left")
    met = {r[0] for r in means.select("content_db").distinct().collect()}  # at most the catalog's databases
    index = V.content_index(spark, sf_dir, {db: t for db, t in CAT.LOGICAL_DBS.items() if db in met} or CAT.LOGICAL_DBS,
                            text_only=True)
    return V.repair_log(rows, index)


@query("repair_literals", oracle=_REPAIR_SQL + " SELECT qid, db_id, repaired, changed FROM rep")
def q_repair_literals(spark, sf_dir):
    return _repaired(spark, sf_dir).select("qid", "db_id", "repaired", "changed")


@query("repair_report", oracle=_REPAIR_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(changed::INT) AS BIGINT) AS n_changed FROM rep""")
def q_repair_report(spark, sf_dir):
    return V.repair_report(_repaired(spark, sf_dir))


@query("repair_changed", oracle=_REPAIR_SQL + " SELECT qid FROM rep WHERE changed")
def q_repair_changed(spark, sf_dir):
    return _repaired(spark, sf_dir).filter("changed").select("qid")


# --- end-to-end prompt construction ---------------------------------------------------------

def _class_picks_sql() -> str:
    return f"""tq AS (SELECT qid, {_sql_toks_sql('query')} AS tk FROM qlog),
cl AS (SELECT qid, {_CLASS_SQL} AS cls FROM tq),
ct AS (SELECT qid AS target_id, cls, {uniform_sql(str(SEED), "'t'", 'qid')} AS s FROM cl),
cp AS (SELECT qid AS demo_id, cls, {uniform_sql(str(SEED), 'qid')} AS u FROM cl),
cpairs AS (SELECT target_id, demo_id, CASE WHEN u - s < 0 THEN u - s + 1.0 ELSE u - s END AS h
           FROM ct JOIN cp USING (cls) WHERE target_id <> demo_id),
picks AS (SELECT * FROM (SELECT target_id, demo_id,
            CAST(row_number() OVER (PARTITION BY target_id ORDER BY h, demo_id) AS BIGINT) AS rank FROM cpairs)
          WHERE rank <= {K})"""


def _prompt_build_sql(template: str = "template_option_1") -> str:
    from shotloom.functions.constants import TEMPLATES
    tpl = TEMPLATES[template]
    nl2 = "chr(10) || chr(10)"
    assert {tpl[k] for k in ("demo_sep", "q_sep", "section_sep")} == {"\n\n"} and tpl["demo_suffix"] is None

    def filled(fmt: str | None, **cols: str) -> str:
        """A format string as a concatenation of literals and columns (NULL where it has none)."""
        if fmt is None:
            return "NULL"
        parts = [cols[p[1:-1]] if p[:1] == "{" else D.lit(p) for p in re.split(r"(\{[a-z]+\})", fmt) if p]
        return " || ".join(parts)

    instr = D.lit(tpl["instruction"])
    n_instr = f"{D.ntok(instr)} + {D.ntok(nl2)}" if tpl["instruction"] else "0"
    qsec = (f"concat_ws({nl2}, {D.lit(tpl['q_prefix'])}, s.schema_text, "
            f"{filled(tpl['q_evidence'], evidence='t.evidence')}, "
            f"{filled(tpl['q_body'], question='t.question')}, {D.lit(tpl['q_suffix'])})")
    demo = filled(tpl["demo_format"], question="coalesce(q.question, '')", query="coalesce(q.query, '')")
    return f"""
WITH {D.QLOG_CTE}, {D.catalog_ctes()}, {_class_picks_sql()},
t AS (SELECT qid AS idx, question, 'star' AS db_id, 'query shape ' || CAST(shape AS VARCHAR) AS evidence FROM qlog),
tqs AS (SELECT t.idx, {qsec} AS q_section FROM t LEFT JOIN schema_t s ON s.db_id = t.db_id),
tb AS (SELECT idx, q_section, {tpl['max_tokens']} - ({n_instr}) - {D.ntok('q_section')} - {D.ntok(nl2)} AS balance FROM tqs),
d AS (SELECT p.target_id, p.demo_id, p.rank,
             {demo} AS dtext
      FROM picks p JOIN qlog q ON q.qid = p.demo_id),
dc AS (SELECT d.*, {D.ntok('dtext')} AS cost, tb.balance FROM d JOIN tb ON tb.idx = d.target_id),
dw AS (SELECT *, rank - 1 AS pos,
         sum(cost) OVER (PARTITION BY target_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
       FROM dc),
dk AS (SELECT *, {D.ntok(D.lit(tpl['demo_prefix']))} + {D.ntok(nl2)} + cum + pos * {D.ntok(nl2)} <= balance AS kept FROM dw),
agg AS (SELECT target_id, array_to_string(list(CAST(demo_id AS VARCHAR) ORDER BY rank), ',') AS ids,
               CAST(count(*) AS BIGINT) AS n_demo,
               coalesce(list(dtext ORDER BY rank) FILTER (WHERE kept), []) AS kept_texts
        FROM dk GROUP BY target_id),
pr AS (SELECT tb.idx, coalesce(agg.ids, '') AS demonstrations_idxs, coalesce(agg.n_demo, 0) AS num_demonstrations,
              CAST(len(coalesce(agg.kept_texts, [])) AS BIGINT) AS num_packed,
              concat_ws({nl2}, {instr},
                        concat_ws({nl2}, {D.lit(tpl['demo_prefix'])}, array_to_string(coalesce(agg.kept_texts, []), {nl2})),
                        tb.q_section) AS prompt
       FROM tb LEFT JOIN agg ON agg.target_id = tb.idx)
SELECT idx, demonstrations_idxs, num_demonstrations, num_packed, prompt, {D.ntok('prompt')} AS num_tokens,
       CASE WHEN {D.ntok('prompt')} > 4096 THEN 'over_budget' WHEN length(prompt) = 0 THEN 'empty' ELSE 'ok' END AS status
FROM pr
"""


def _prompt_inputs(spark, sf_dir):
    """Targets, class-matched picks, pool and schemas of the query log, read once."""
    q = stored(S.qlog(spark, sf_dir), "qlog")
    c = q.select("qid", R.structure_class(T.sql_tokens("query")).alias("cls"))
    picks = R.seeded_sample(c, c, K, SEED, target_id="qid", pool_id="qid",
                            target_group="cls", pool_group="cls", exclude_self=True)
    targets = q.select(F.col("qid").alias("idx"), "question", "db_id",
                       F.concat(F.lit("query shape "), F.col("shape").cast("string")).alias("evidence"))
    pool = q.select(F.col("qid").alias("idx"), "question", "query")
    return targets, picks, pool, _per_log_db(q, CAT.schema_text(CAT.catalog_columns(spark, sf_dir)))


def _prompt_query(template: str, evidence: str | None = None):
    def run(spark, sf_dir):
        targets, picks, pool, schemas = _prompt_inputs(spark, sf_dir)
        out = PR.build_prompts(targets, picks, pool, schemas, template, evidence)
        return out.select("idx",
                          F.coalesce(F.array_join(F.transform("demonstrations_idxs", lambda x: x.cast("string")), ","),
                                     F.lit("")).alias("demonstrations_idxs"),
                          F.coalesce("num_demonstrations", F.lit(0)).cast("bigint").alias("num_demonstrations"),
                          "num_packed", "prompt", "num_tokens", "status")
    return run


# T5: one key for each of the four section templates; the fourth carries evidence
q_prompt_build = query("prompt_build", oracle=_prompt_build_sql())(_prompt_query("template_option_1"))
for _n, _ev in ((2, None), (3, None), (4, "evidence")):
    query(f"prompt_build_{_n}", oracle=_prompt_build_sql(f"template_option_{_n}"))(
        _prompt_query(f"template_option_{_n}", _ev))


def _prompt_flat_sql(option: str = "option_1") -> str:
    from shotloom.functions.constants import FLAT_TEMPLATES
    tpl = FLAT_TEMPLATES[option]
    nl2 = "chr(10) || chr(10)"
    qa, qb = tpl["question"].split("{question}")
    q_part = f"({D.lit(qa)} || t.question || {D.lit(qb)})"
    fixed = (f"{D.ntok(D.lit(tpl['head']))} + {D.ntok(D.lit(tpl['demo_header']))} + {D.ntok(D.lit(tpl['schema_header']))}"
             f" + coalesce({D.ntok('s.schema_text')}, 0) + {D.ntok(q_part)}")
    return f"""
WITH {D.QLOG_CTE}, {D.catalog_ctes()}, {_class_picks_sql()},
t AS (SELECT qid AS idx, question, 'star' AS db_id FROM qlog),
tb AS (SELECT t.idx, t.question, s.schema_text, 4096 - ({fixed}) AS balance FROM t LEFT JOIN schema_t s ON s.db_id = t.db_id),
d AS (SELECT p.target_id, p.rank, '### Answer the following question: ' || coalesce(q.question, '') || chr(10) || coalesce(q.query, '') AS dtext
      FROM picks p JOIN qlog q ON q.qid = p.demo_id),
dw AS (SELECT d.*, tb.balance, rank - 1 AS pos,
         sum({D.ntok('dtext')}) OVER (PARTITION BY target_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
       FROM d JOIN tb ON tb.idx = d.target_id),
agg AS (SELECT target_id, coalesce(list(dtext ORDER BY rank) FILTER (WHERE cum + pos * {D.ntok(nl2)} <= balance), []) AS kept
        FROM dw GROUP BY target_id),
pr AS (SELECT tb.idx, CAST(len(coalesce(agg.kept, [])) AS BIGINT) AS num_packed,
         {D.lit(tpl['head'])}
         || CASE WHEN len(coalesce(agg.kept, [])) > 0 THEN {D.lit(tpl['demo_header'])} || array_to_string(agg.kept, {nl2}) || {nl2} ELSE '' END
         || CASE WHEN coalesce(length(tb.schema_text), 0) > 0 THEN {D.lit(tpl['schema_header'])} || tb.schema_text || {nl2} ELSE '' END
         || {D.lit(qa)} || tb.question || {D.lit(qb)} AS prompt
       FROM tb LEFT JOIN agg ON agg.target_id = tb.idx)
SELECT idx, num_packed, prompt, {D.ntok('prompt')} AS num_tokens FROM pr
"""


def _flat_query(option: str):
    return lambda spark, sf_dir: PR.build_flat_prompts(*_prompt_inputs(spark, sf_dir), option)


# One key for each of the three flat templates
q_prompt_build_flat = query("prompt_build_flat", oracle=_prompt_flat_sql())(_flat_query("option_1"))
for _n in (2, 3):
    query(f"prompt_build_flat_{_n}", oracle=_prompt_flat_sql(f"option_{_n}"))(_flat_query(f"option_{_n}"))


# --- SQL graph tables -----------------------------------------------------------------------

from shotloom.operators import sqlgraph as G  # noqa: E402

_GSRC = (f"{D.QLOG_CTE} SELECT qid, {D.double_to_single(D.join_split_ops(D.postprocess('query')))} AS q FROM qlog")


def _names(spark, sf_dir):
    return G.catalog_names(CAT.catalog_columns(spark, sf_dir))


def _graph_pair(name: str, select: str):
    @query(name, oracle=G.duck_graph_query(f"WITH {_GSRC}", select))
    def _q(spark, sf_dir):
        return G.graph_query(S.qlog(spark, sf_dir).select("qid", "query"), select, _names(spark, sf_dir))
    return _q


_graph_pair("sql_tokens", "SELECT qid, pos, tok, kind, CAST(depth AS BIGINT) AS depth FROM tk")
_graph_pair("sql_alias_map", "SELECT DISTINCT qid, tok AS alias, atable AS table_name FROM tk WHERE kind = 'alias'")
_graph_pair("sql_nodes", "SELECT qid, node_id, val, type FROM nodes")
_graph_pair("sql_edges", "SELECT qid, src, dst, label FROM edges")
_graph_pair("sql_columns", "SELECT qid, pos, tok, cname AS column_name, coalesce(ctable, 'UNRESOLVED') AS table_name "
            "FROM tk WHERE kind = 'column'")
_graph_pair("sql_graph_stats", """SELECT n.qid, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges,
  n.n_tables, n.n_columns, n.n_values FROM
  (SELECT qid, CAST(count(*) AS BIGINT) AS n_nodes, CAST(sum(CASE WHEN type = 'TABLE' THEN 1 ELSE 0 END) AS BIGINT) AS n_tables,
          CAST(sum(CASE WHEN type = 'COLUMN' THEN 1 ELSE 0 END) AS BIGINT) AS n_columns,
          CAST(sum(CASE WHEN type = 'VALUE' THEN 1 ELSE 0 END) AS BIGINT) AS n_values FROM nodes GROUP BY qid) n
  LEFT JOIN (SELECT qid, CAST(count(*) AS BIGINT) AS n_edges FROM edges GROUP BY qid) e ON e.qid = n.qid""")


@query("tables_columns", oracle=G.duck_graph_query(f"WITH {_GSRC}", """
SELECT t.qid, t.node_id AS table_node, CAST(count(c.val) AS BIGINT) AS n_columns,
       coalesce(list_sort(list(c.val) FILTER (WHERE c.val IS NOT NULL)), []) AS columns
FROM nodes t LEFT JOIN edges e ON e.qid IS NOT DISTINCT FROM t.qid AND e.dst = t.node_id AND e.label = 'belongs_to'
  LEFT JOIN nodes c ON c.qid IS NOT DISTINCT FROM e.qid AND c.node_id = e.src AND c.type = 'COLUMN'
WHERE t.type = 'TABLE' GROUP BY t.qid, t.node_id"""))
def q_tables_columns(spark, sf_dir):
    return G.tables_columns(G.graphs(S.qlog(spark, sf_dir).select("qid", "query"), _names(spark, sf_dir)))


# --- contrastive pairs and metrics ------------------------------------------------------------

from shotloom.operators import contrast as N  # noqa: E402

N_POS, N_NEG, BATCH = 3, 5, 8


def _emb(spark, sf_dir):
    return S.load(spark, sf_dir, "embeddings").withColumn("db_id", F.col("label").cast("string"))


_E_CTE = "e AS (SELECT vec_id, CAST(label AS VARCHAR) AS db, embedding::DOUBLE[] AS v FROM embeddings)"


def _sample_sql(name: str, k: int, join_cond: str) -> str:
    return f"""{name}_t AS (SELECT vec_id AS target_id, db, {uniform_sql(str(SEED), "'t'", 'vec_id')} AS s FROM e),
{name}_p AS (SELECT vec_id AS demo_id, db, {uniform_sql(str(SEED), 'vec_id')} AS u FROM e),
{name}_pairs AS (SELECT target_id, demo_id, CASE WHEN u - s < 0 THEN u - s + 1.0 ELSE u - s END AS h
   FROM {name}_t t JOIN {name}_p p ON {join_cond}),
{name} AS (SELECT * FROM (SELECT target_id AS anchor_id, demo_id AS member_id,
   CAST(row_number() OVER (PARTITION BY target_id ORDER BY h, demo_id) AS BIGINT) AS slot FROM {name}_pairs) WHERE slot <= {k})"""


_NEG_SQL = _sample_sql("negs", N_NEG, "t.db IS DISTINCT FROM p.db")
_POS_SQL = _sample_sql("poss", N_POS, "t.db = p.db AND t.target_id <> p.demo_id")
_PAIRS_SQL = f"""{_E_CTE}, {_NEG_SQL}, {_POS_SQL},
pairs AS (SELECT anchor_id, 'positive' AS role, slot, member_id FROM poss
          UNION ALL SELECT anchor_id, 'negative' AS role, slot, member_id FROM negs)"""


@query("neg_uniform", oracle=f"WITH {_E_CTE}, {_NEG_SQL} SELECT anchor_id, member_id AS neg_id, slot FROM negs")
def q_neg_uniform(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return N.neg_uniform(e, e, N_NEG, SEED)


@query("pair_mine", oracle=f"WITH {_PAIRS_SQL} SELECT * FROM pairs")
def q_pair_mine(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return N.pair_mine(e, e, N_POS, N_NEG, SEED)


@query("contrastive_metrics", oracle=f"""
WITH {_PAIRS_SQL},
sc AS (SELECT pairs.*, exp((CASE WHEN sqrt(list_dot_product(a.v, a.v)) = 0 OR sqrt(list_dot_product(m.v, m.v)) = 0 THEN 0.0
              ELSE list_dot_product(a.v, m.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(m.v, m.v))) END) / 0.5) AS score
       FROM pairs JOIN e a ON a.vec_id = pairs.anchor_id JOIN e m ON m.vec_id = pairs.member_id),
per AS (SELECT anchor_id, sum(CASE WHEN role = 'positive' THEN score ELSE 0.0 END) AS pos_sum, sum(score) AS all_sum,
               CAST(sum(CASE WHEN role = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
               CAST(sum(CASE WHEN role = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM sc GROUP BY anchor_id)
SELECT anchor_id, n_pos, n_neg, round(-ln(pos_sum / all_sum), 6) AS loss, round(pos_sum / n_pos, 6) AS avg_pos_score,
       round((all_sum - pos_sum) / n_neg, 6) AS avg_neg_score FROM per
""")
def q_contrastive_metrics(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return N.contrastive_metrics(N.pair_mine(e, e, N_POS, N_NEG, SEED), e)


@query("batch_uniformity", oracle=f"""
WITH {_E_CTE}, b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / {BATCH}) AS BIGINT) AS batch FROM e),
pr AS (SELECT x.batch, CASE WHEN sqrt(list_dot_product(x.v, x.v)) = 0 OR sqrt(list_dot_product(y.v, y.v)) = 0 THEN 0.0
         ELSE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) END AS c
       FROM b x JOIN b y ON x.batch = y.batch)
SELECT batch, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(c), 6) AS cos_mean, round(stddev_pop(c), 6) AS cos_std
FROM pr GROUP BY batch
""")
def q_batch_uniformity(spark, sf_dir):
    return N.batch_uniformity(S.load(spark, sf_dir, "embeddings"), BATCH)


@query("pad_batches", oracle=f"""
WITH g AS (SELECT conv_id, count(*) AS n, max(turn) AS last_item FROM conversations GROUP BY conv_id),
gb AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY conv_id) - 1) / {BATCH}) AS BIGINT) AS batch FROM g),
gm AS (SELECT *, max(n) OVER (PARTITION BY batch) AS bm FROM gb)
SELECT c.conv_id, gm.batch, c.turn AS item, false AS padded FROM conversations c JOIN gm ON gm.conv_id = c.conv_id
UNION ALL
SELECT conv_id, batch, last_item AS item, true AS padded FROM (SELECT *, unnest(range(n, bm)) AS slot FROM gm)
""")
def q_pad_batches(spark, sf_dir):
    return N.pad_rows(S.load(spark, sf_dir, "conversations"), "conv_id", "turn", BATCH)


def _neg_pct_sql() -> str:
    cos = ("CASE WHEN sqrt(list_dot_product(a.v, a.v)) = 0 OR sqrt(list_dot_product(b.v, b.v)) = 0 THEN 0.0 "
           "ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(b.v, b.v)) * sqrt(list_dot_product(a.v, a.v))) END")
    return f"""
WITH {_E_CTE},
pr AS (SELECT a.vec_id AS anchor_id, b.vec_id AS nid, {cos} AS sim FROM e a JOIN e b ON a.db <> b.db),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY sim, nid) - 1 AS rk,
             count(*) OVER (PARTITION BY anchor_id) AS v FROM pr),
av AS (SELECT DISTINCT anchor_id, v FROM r),
bands AS (SELECT anchor_id, 'hard' AS band, CAST(floor(v * 0.3::DOUBLE) AS BIGINT) AS st,
                 CAST(floor(v * 0.6::DOUBLE) AS BIGINT) AS sp, 2 AS cnt FROM av
          UNION ALL SELECT anchor_id, 'easy', CAST(floor(v * 0.0::DOUBLE) AS BIGINT), CAST(floor(v * 0.3::DOUBLE) AS BIGINT), 3 FROM av),
b2 AS (SELECT *, sp - st AS m, CAST(floor({uniform_sql(str(SEED), 'band', 'anchor_id')} * (sp - st)) AS BIGINT) AS off
       FROM bands WHERE sp - st > 0),
picks AS (SELECT anchor_id, band, j + 1 AS slot, st + (off + j) % m AS rk FROM (SELECT *, unnest(range(least(cnt, m))) AS j FROM b2))
SELECT p.anchor_id, r.nid AS neg_id, p.band, CAST(p.slot AS BIGINT) AS slot FROM picks p JOIN r ON r.anchor_id = p.anchor_id AND r.rk = p.rk
"""


@query("neg_percentile", oracle=_neg_pct_sql())
def q_neg_percentile(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return N.neg_percentile(e, e, SEED)


# --- graph features and augmentation ----------------------------------------------------------

from shotloom.operators import augment as A  # noqa: E402
from shotloom.functions.constants import CRITICAL_KEYWORDS, KEYWORD_REPLACEMENTS  # noqa: E402
from shotloom.functions import hashing as HS  # noqa: E402

MASK_P, KW_P, N_AUG = 0.5, 0.7, 2
TYPE_IDX = {"ROOT": 0, "SQL_KEYWORD": 1, "TABLE": 2, "COLUMN": 3, "VALUE": 4}
FEAT_DIM = 16


def _graph(spark, sf_dir):
    return G.graph_tables(S.qlog(spark, sf_dir).select("qid", "query"), _names(spark, sf_dir))


def _duck_graph(select: str, extra: str = "") -> str:
    return G.duck_graph_query(f"WITH {_GSRC}", (", " + extra if extra else "") + "\n" + select)


def _node_text_sql(ident: str) -> str:
    return (f"CASE WHEN starts_with({ident}, 'SQL_KEYWORD') THEN replace(regexp_replace({ident}, '_[0-9]+$', ''), '_', ' ') "
            f"ELSE replace({ident}, '_', ' ') END")


@query("node_text", oracle=_duck_graph(f"SELECT qid, node_id, {_node_text_sql('node_id')} AS text FROM nodes"))
def q_node_text(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return nodes.select("qid", "node_id", A.node_text(F.col("node_id")).alias("text"))


_CRIT = ", ".join(D.lit(k) for k in CRITICAL_KEYWORDS)


@query("aug_mask", oracle=_duck_graph(f"""SELECT qid, node_id, {_node_text_sql('coalesce(aug, node_id)')} AS text FROM (
  SELECT *, CASE WHEN type <> 'ROOT' AND NOT (type = 'SQL_KEYWORD' AND upper(val) IN ({_CRIT}))
                  AND {D.uniform(str(SEED), "'mask'", 'qid', 'node_id')} < {MASK_P} THEN '<mask>' END AS aug FROM nodes)"""))
def q_aug_mask(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    m = A.mask_nodes(nodes, MASK_P, SEED)
    return m.select("qid", "node_id", A.node_text(F.col("node_id"), F.col("aug_text")).alias("text"))


def _kw_case() -> str:
    arms = " ".join(f"WHEN {D.lit(k)} THEN [{', '.join(D.lit(x) for x in v)}]" for k, v in KEYWORD_REPLACEMENTS.items())
    return f"CASE upper(val) {arms} END"


@query("aug_keyword", oracle=_duck_graph(f"""
SELECT e.qid, coalesce(a.new_id, e.src) AS src, coalesce(b.new_id, e.dst) AS dst, e.label
FROM edges e LEFT JOIN mp a ON a.qid = e.qid AND a.old_id = e.src LEFT JOIN mp b ON b.qid = e.qid AND b.old_id = e.dst""",
extra=f"""kw AS (SELECT *, {_kw_case()} AS alts FROM nodes WHERE type = 'SQL_KEYWORD'),
ch AS (SELECT *, alts[CAST(floor({D.uniform(str(SEED), "'kwc'", 'qid', 'node_id')} * len(alts)) AS BIGINT) + 1] AS new_kw
       FROM kw WHERE alts IS NOT NULL AND {D.uniform(str(SEED), "'kw'", 'qid', 'node_id')} <= {KW_P}),
ex AS (SELECT qid, upper(val) AS kwname, max(TRY_CAST(regexp_extract(node_id, '_([0-9]+)$', 1) AS BIGINT)) AS max_idx
       FROM kw GROUP BY qid, upper(val)),
mp AS (SELECT ch.qid, ch.node_id AS old_id, 'SQL_KEYWORD_' || ch.new_kw || '_' ||
              CAST(coalesce(ex.max_idx, -1) + row_number() OVER (PARTITION BY ch.qid, ch.new_kw ORDER BY ch.node_id) AS VARCHAR) AS new_id
       FROM ch LEFT JOIN ex ON ex.qid = ch.qid AND ex.kwname = ch.new_kw)"""))
def q_aug_keyword(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    _, e2 = A.replace_keywords(nodes, edges, KW_P, SEED)
    return e2


_OPS_VALUES = ", ".join(f"({D.lit(k)}, {v}::DOUBLE)" for k, v in A.OPERATOR_WEIGHTS.items())


@query("sample_augmenters", oracle=f"""
WITH {D.QLOG_CTE}, ops(op, w) AS (VALUES {_OPS_VALUES}),
k AS (SELECT q.qid, ops.op, round(-ln({D.uniform(str(SEED), 'q.qid', 'ops.op')}) / ops.w, 9) AS key FROM qlog q, ops)
SELECT qid, op, pick FROM (SELECT qid, op, CAST(row_number() OVER (PARTITION BY qid ORDER BY key, op) AS BIGINT) AS pick FROM k)
WHERE pick <= {N_AUG}
""")
def q_sample_augmenters(spark, sf_dir):
    return A.sample_augmenters(S.qlog(spark, sf_dir).select("qid"), N_AUG, SEED)


def _delete_ctes(tag: str, nodes: str, edges: str, targets: str) -> str:
    """CTEs ``n_<tag>`` and ``e_<tag>``: the graphs without the target nodes and what only they reach."""
    return f"""tg_{tag} AS ({targets}),
k_{tag} AS (SELECT e.* FROM {edges} e WHERE NOT EXISTS (SELECT 1 FROM tg_{tag} t WHERE t.qid = e.qid AND t.node_id = e.dst)),
r_{tag}(qid, node) AS (SELECT qid, node_id FROM {nodes} WHERE type = 'ROOT' AND qid IN (SELECT qid FROM tg_{tag})
  UNION SELECT k.qid, k.dst FROM r_{tag} r JOIN k_{tag} k ON k.qid = r.qid AND k.src = r.node),
n_{tag} AS (SELECT n.qid, n.node_id, n.val, n.type FROM {nodes} n LEFT JOIN r_{tag} r ON r.qid = n.qid AND r.node = n.node_id
  WHERE r.node IS NOT NULL OR n.qid NOT IN (SELECT qid FROM tg_{tag})),
e_{tag} AS (SELECT k.qid, k.src, k.dst, k.label FROM k_{tag} k LEFT JOIN r_{tag} a ON a.qid = k.qid AND a.node = k.src
  LEFT JOIN r_{tag} b ON b.qid = k.qid AND b.node = k.dst
  WHERE a.node IS NOT NULL AND b.node IS NOT NULL OR k.qid NOT IN (SELECT qid FROM tg_{tag}))"""


def _graph_rows_sql(nodes: str, edges: str) -> str:
    return (f"SELECT qid, 'node' AS part, node_id AS src, CAST(NULL AS VARCHAR) AS dst, type AS label FROM {nodes} "
            f"UNION ALL SELECT qid, 'edge', src, dst, label FROM {edges}")


def _delete_sql(targets: str) -> str:
    return _duck_graph(_graph_rows_sql("n_x", "e_x"), extra=_delete_ctes("x", "nodes", "edges", targets))


def _pred_targets_sql(nodes: str, word: str, prob: float) -> str:
    return f"""SELECT qid, node_id FROM (
  SELECT qid, node_id, val, row_number() OVER (PARTITION BY qid, val ORDER BY
         {D.uniform(str(SEED), "'predpick'", 'qid', 'node_id')}, node_id) AS rk
  FROM {nodes} WHERE type = 'SQL_KEYWORD' AND val = '{word}')
  WHERE rk = 1 AND {D.uniform(str(SEED), "'pred'", 'qid', 'val')} < {prob}"""


def _simplify_ctes(tag: str, nodes: str, edges: str, prob: float) -> str:
    """CTEs ``n_<tag>`` and ``e_<tag>``: one AND / OR under a WHERE replaced by one of its operands."""
    def pick(rows: str, part: str, key: str, of: str) -> str:
        return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY "
                f"{D.uniform(str(SEED), key, 'qid', of)}, {of}) AS rk FROM ({rows})) WHERE rk = 1")

    where = f"SELECT qid, node_id FROM {nodes} WHERE type = 'SQL_KEYWORD' AND val = 'WHERE' AND {D.uniform(str(SEED), _q('simplify'), 'qid')} < {prob}"
    joint = f"SELECT qid, node_id FROM {nodes} WHERE type = 'SQL_KEYWORD' AND val IN ('AND', 'OR')"
    return f"""w_{tag} AS ({pick(where, 'qid', _q('simwhere'), 'node_id')}),
u_{tag}(qid, node) AS (SELECT qid, node_id FROM w_{tag}
  UNION SELECT e.qid, e.dst FROM u_{tag} u JOIN {edges} e ON e.qid = u.qid AND e.src = u.node),
j_{tag} AS ({joint}),
c_{tag} AS ({pick(f"SELECT j.* FROM j_{tag} j JOIN u_{tag} u ON u.qid = j.qid AND u.node = j.node_id", 'qid', _q('simnode'), 'node_id')}),
f_{tag} AS (SELECT c.qid, c.node_id FROM c_{tag} c
  WHERE (SELECT count(DISTINCT src) FROM {edges} e WHERE e.qid = c.qid AND e.dst = c.node_id) = 1
    AND (SELECT count(DISTINCT dst) FROM {edges} e WHERE e.qid = c.qid AND e.src = c.node_id) = 2),
p_{tag} AS (SELECT qid, node_id, child FROM (
  SELECT f.qid, f.node_id, e.dst AS child, row_number() OVER (PARTITION BY f.qid, f.node_id ORDER BY
         CASE WHEN e.dst IN (SELECT node_id FROM j_{tag} j WHERE j.qid = f.qid) THEN 0 ELSE 1 END,
         {D.uniform(str(SEED), _q('simkeep'), 'f.qid', 'e.dst')}, e.dst) AS rk
  FROM f_{tag} f JOIN (SELECT DISTINCT qid, src, dst FROM {edges}) e ON e.qid = f.qid AND e.src = f.node_id) WHERE rk = 1),
m_{tag} AS (SELECT qid, src, dst, label FROM {edges}
  UNION SELECT e.qid, e.src, p.child, e.label FROM p_{tag} p JOIN {edges} e ON e.qid = p.qid AND e.dst = p.node_id),
{_delete_ctes(tag, nodes, f"m_{tag}", f"SELECT qid, node_id FROM f_{tag}")}"""


def _q(word: str) -> str:
    return f"'{word}'"


@query("subgraph_delete", oracle=_delete_sql("SELECT qid, node_id FROM nodes WHERE type = 'SQL_KEYWORD' AND val = 'WHERE'"))
def q_subgraph_delete(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    t = nodes.filter((F.col("type") == "SQL_KEYWORD") & (F.col("val") == "WHERE")).select("qid", "node_id")
    return A.graph_rows(*A.subgraph_delete(nodes, edges, t))


@query("aug_simplify", oracle=_duck_graph(_graph_rows_sql("n_s", "e_s"), extra=_simplify_ctes("s", "nodes", "edges", 0.5)))
def q_aug_simplify(spark, sf_dir):
    return A.graph_rows(*A.simplify_conditions(*_graph(spark, sf_dir), SEED))


@query("aug_predicate", oracle=_duck_graph(_graph_rows_sql("n_h", "e_h"), extra=",\n".join((
    _delete_ctes("w", "nodes", "edges", _pred_targets_sql("nodes", "WHERE", 0.3)),
    _simplify_ctes("s", "n_w", "e_w", 0.5),
    _delete_ctes("h", "n_s", "e_s", _pred_targets_sql("n_s", "HAVING", 0.2))))))
def q_aug_predicate(spark, sf_dir):
    return A.graph_rows(*A.predicate_modification(*_graph(spark, sf_dir), SEED))


@query("aug_join", oracle=_delete_sql(f"""SELECT qid, node_id FROM (
  SELECT qid, sel, node_id, row_number() OVER (PARTITION BY qid, sel ORDER BY {D.uniform(str(SEED), "'join'", 'qid', 'node_id')}, node_id) AS rk
  FROM (SELECT qid, src AS sel, dst AS node_id, count(*) OVER (PARTITION BY qid, src) AS n
        FROM edges WHERE starts_with(dst, 'SQL_KEYWORD_JOIN_')) WHERE n >= 2)
  WHERE rk = 1 AND {D.uniform(str(SEED), "'joingate'", 'qid', 'sel')} < 0.8"""))
def q_aug_join(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return A.graph_rows(*A.subgraph_delete(nodes, edges, A.join_targets(nodes, edges, SEED)))


@query("edge_index", oracle=_duck_graph("""
SELECT e.qid, a.nidx AS src_idx, b.nidx AS dst_idx, 'fwd' AS dir FROM edges e
  JOIN nid a ON a.qid = e.qid AND a.node_id = e.src JOIN nid b ON b.qid = e.qid AND b.node_id = e.dst
UNION ALL
SELECT e.qid, b.nidx, a.nidx, 'rev' FROM edges e
  JOIN nid a ON a.qid = e.qid AND a.node_id = e.src JOIN nid b ON b.qid = e.qid AND b.node_id = e.dst""",
extra="nid AS (SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY node_id) - 1 AS BIGINT) AS nidx FROM nodes)"))
def q_edge_index(spark, sf_dir):
    from pyspark.sql import Window
    nodes, edges = _graph(spark, sf_dir)
    nid = nodes.select("qid", "node_id", (F.row_number().over(Window.partitionBy("qid").orderBy("node_id")) - 1)
                       .cast("bigint").alias("nidx"))
    # a graph's numbers travel as one array with its qid: edges are spread by qid once
    e = edges.join(A.per_graph(nid, "ids", "node_id", "nidx"), "qid")
    for end in ("src", "dst"):
        hits = F.filter("ids", lambda n: n["node_id"] == F.col(end))
        e = e.withColumn("_n", F.explode_outer(hits)).filter("_n IS NOT NULL").withColumn(f"{end}_idx", F.col("_n.nidx"))
    both = F.array(F.struct(F.col("src_idx"), F.col("dst_idx"), F.lit("fwd").alias("dir")),
                   F.struct(F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"), F.lit("rev").alias("dir")))
    return e.select("qid", F.explode(both).alias("x")).select("qid", "x.*")


_TYPE_CASE = "CASE type " + " ".join(f"WHEN {D.lit(k)} THEN {v}" for k, v in TYPE_IDX.items()) + " END"


@query("node_features", oracle=_duck_graph(f"""
SELECT qid, node_id, CAST(type_idx AS BIGINT) AS type_idx, bucket, CAST(count(*) AS BIGINT) AS cnt FROM (
  SELECT qid, node_id, {_TYPE_CASE} AS type_idx,
         CAST((('0x' || substr(md5(w), 1, 8))::BIGINT) % {FEAT_DIM} AS BIGINT) AS bucket
  FROM (SELECT qid, node_id, type, unnest(regexp_extract_all(lower({_node_text_sql('node_id')}), {D.lit(T.WORD_RE)})) AS w FROM nodes))
GROUP BY qid, node_id, type_idx, bucket"""))
def q_node_features(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    tmap = F.create_map(*[x for k, v in TYPE_IDX.items() for x in (F.lit(k), F.lit(v))])
    # a node is one row, so its words are counted there
    buckets = F.transform(T.words(F.lower(A.node_text(F.col("node_id")))), lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(FEAT_DIM)))
    counts = F.transform(F.array(buckets), lambda bs: F.transform(F.array_distinct(bs), lambda x: F.struct(
        x.alias("bucket"), F.size(F.filter(bs, lambda y: y == x)).cast("bigint").alias("cnt"))))[0]
    out = nodes.select("qid", "node_id", tmap[F.col("type")].cast("bigint").alias("type_idx"), F.explode_outer(counts).alias("x"))
    return out.filter("x IS NOT NULL").select("qid", "node_id", "type_idx", "x.*")


def _one_hot(nodes):
    """``(qid, node_id, h)``: the type of every node as a vector."""
    tmap = F.create_map(*[x for k, v in TYPE_IDX.items() for x in (F.lit(k), F.lit(v))])
    return nodes.select("qid", "node_id", F.array(*[F.when(tmap[F.col("type")] == i, 1.0).otherwise(0.0) for i in range(5)]).alias("h"))


@query("graph_vectors", oracle=_duck_graph(f"""
SELECT qid, {", ".join(f"round(avg(h{i}), 6) AS d{i}" for i in range(5))} FROM (
  SELECT a.qid, a.v, {", ".join(f"sum(CASE WHEN nt.type_idx = {i} THEN 1.0 ELSE 0.0 END / sqrt(du.deg * dv.deg)) AS h{i}" for i in range(5))}
  FROM adj a JOIN deg du ON du.qid = a.qid AND du.v = a.u JOIN deg dv ON dv.qid = a.qid AND dv.v = a.v
       JOIN nt ON nt.qid = a.qid AND nt.node_id = a.u
  GROUP BY a.qid, a.v) GROUP BY qid""",
extra=f"""adj AS (SELECT DISTINCT qid, u, v FROM (SELECT qid, src AS u, dst AS v FROM edges UNION ALL SELECT qid, dst, src FROM edges
                   UNION ALL SELECT qid, node_id, node_id FROM nodes)),
deg AS (SELECT qid, v, count(*) AS deg FROM adj GROUP BY qid, v),
nt AS (SELECT qid, node_id, {_TYPE_CASE} AS type_idx FROM nodes)"""))
def q_graph_vectors(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    out = A.readout(A.propagate(_one_hot(nodes), edges, 1), 5, "mean")
    return out.select("qid", *[F.round(f"mean{i}", 6).alias(f"d{i}") for i in range(5)])


def _readout_sql() -> str:
    def hop(h: str) -> str:
        sums = ", ".join(f"sum({h}.h{i} / sqrt(du.deg * dv.deg)) AS h{i}" for i in range(5))
        return (f"SELECT a.qid, a.v AS node_id, {sums} FROM adj a JOIN deg du ON du.qid = a.qid AND du.v = a.u "
                f"JOIN deg dv ON dv.qid = a.qid AND dv.v = a.v JOIN {h} ON {h}.qid = a.qid AND {h}.node_id = a.u GROUP BY a.qid, a.v")

    first = ", ".join(f"CASE WHEN {_TYPE_CASE} = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h{i}" for i in range(5))
    out = ", ".join(f"round({fn}(h{i}), 6) AS {k}{i}" for k, fn in (("mean", "avg"), ("max", "max"), ("sum", "sum")) for i in range(5))
    return _duck_graph(f"SELECT qid, {out} FROM two GROUP BY qid", extra=f"""
adj AS (SELECT DISTINCT qid, u, v FROM (SELECT qid, src AS u, dst AS v FROM edges UNION ALL SELECT qid, dst, src FROM edges
        UNION ALL SELECT qid, node_id, node_id FROM nodes)),
deg AS (SELECT qid, v, count(*) AS deg FROM adj GROUP BY qid, v),
zero AS (SELECT qid, node_id, {first} FROM nodes), one AS ({hop("zero")}), two AS ({hop("one")})""")


@query("graph_readout", oracle=_readout_sql())
def q_graph_readout(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    out = A.readout(A.propagate(_one_hot(nodes), edges, 2), 5)
    return out.select("qid", *[F.round(c, 6).alias(c) for c in out.columns if c != "qid"])


NOT_P = 0.7


@query("aug_not_toggle", oracle=_duck_graph("SELECT DISTINCT qid, src, dst, label FROM e2", extra=f"""
ch AS (SELECT qid, node_id AS x FROM nodes WHERE upper(val) IN ('IN', 'LIKE')
       AND {D.uniform(str(SEED), "'not'", 'qid', 'node_id')} <= {NOT_P}),
pa AS (SELECT e.qid, e.src, e.dst, e.label, n.node_id IS NOT NULL AS src_is_not FROM edges e JOIN ch ON ch.qid = e.qid AND ch.x = e.dst
       LEFT JOIN (SELECT qid, node_id FROM nodes WHERE upper(val) = 'NOT') n ON n.qid = e.qid AND n.node_id = e.src),
dn AS (SELECT qid, src AS not_id, dst AS x FROM pa WHERE src_is_not),
mx AS (SELECT qid, max(TRY_CAST(regexp_extract(node_id, '_([0-9]+)$', 1) AS BIGINT)) AS max_not FROM nodes
       WHERE upper(val) = 'NOT' GROUP BY qid),
ad AS (SELECT pa.qid, pa.src, pa.dst, pa.label, 'SQL_KEYWORD_NOT_' ||
              CAST(coalesce(mx.max_not, -1) + row_number() OVER (PARTITION BY pa.qid ORDER BY pa.dst, pa.src) AS VARCHAR) AS not_id
       FROM pa LEFT JOIN mx ON mx.qid = pa.qid WHERE NOT pa.src_is_not),
e1 AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ad WHERE ad.qid = e.qid AND ad.src = e.src AND ad.dst = e.dst)
       AND NOT EXISTS (SELECT 1 FROM dn WHERE dn.qid = e.qid AND (dn.not_id = e.src OR dn.not_id = e.dst))),
rw AS (SELECT e.qid, e.src, dn.x AS dst, e.label FROM edges e JOIN dn ON dn.qid = e.qid AND dn.not_id = e.dst),
e2 AS (SELECT qid, src, dst, label FROM e1 UNION ALL SELECT * FROM rw
       UNION ALL SELECT qid, src, not_id, label FROM ad UNION ALL SELECT qid, not_id, dst, 'this' FROM ad)"""))
def q_aug_not_toggle(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    _, e2 = A.toggle_not(nodes, edges, NOT_P, SEED)
    return e2


VAL_P = 0.8


@query("aug_value", oracle=_duck_graph("SELECT DISTINCT qid, src, dst, label FROM e2", extra=f"""
wl0 AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), {D.lit(T.WORD_RE)})) AS w
        FROM benchmark) WHERE length(w) >= 3),
wl AS (SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS widx FROM wl0),
nw AS (SELECT count(*) AS n FROM wl),
ch AS (SELECT qid, node_id, val FROM nodes WHERE type = 'VALUE' AND {D.uniform(str(SEED), "'val'", 'qid', 'node_id')} <= {VAL_P}),
ints AS (SELECT qid, node_id, CAST(CAST(10.0 ^ (length(val) - 1) + floor({D.uniform(str(SEED), "'valn'", 'qid', 'node_id')}
                 * (10.0 ^ (length(val) - 1) * 9)) AS BIGINT) AS VARCHAR) AS new_val
         FROM ch WHERE regexp_full_match(val, '[0-9]+')),
st AS (SELECT * FROM ch WHERE NOT regexp_full_match(val, '[0-9]+') AND NOT regexp_full_match(val, '[0-9]*[.][0-9]+')),
pt AS (SELECT qid, node_id, unnest(CASE WHEN contains(val, '%') THEN string_split(val, '%') ELSE [val] END) AS part,
              generate_subscripts(CASE WHEN contains(val, '%') THEN string_split(val, '%') ELSE [val] END, 1) - 1 AS pos FROM st),
pw AS (SELECT pt.*, CASE WHEN length(trim(coalesce(part, ''))) = 0 THEN ''
         ELSE (SELECT word FROM wl WHERE wl.widx = CAST(floor({D.uniform(str(SEED), "'valw'", 'pt.qid', 'pt.node_id', 'pt.pos')}
               * (SELECT n FROM nw)) AS BIGINT)) END AS np FROM pt),
sn AS (SELECT qid, node_id, array_to_string(list(np ORDER BY pos), '%') AS new_val FROM pw GROUP BY qid, node_id),
mp AS (SELECT qid, node_id AS old_id, 'VALUE_' || new_val AS new_id FROM ints UNION ALL SELECT qid, node_id, 'VALUE_' || new_val FROM sn),
e2 AS (SELECT e.qid, coalesce(a.new_id, e.src) AS src, coalesce(b.new_id, e.dst) AS dst, e.label FROM edges e
       LEFT JOIN mp a ON a.qid = e.qid AND a.old_id = e.src LEFT JOIN mp b ON b.qid = e.qid AND b.old_id = e.dst)"""))
def q_aug_value(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    words = A.word_list(S.load(spark, sf_dir, "benchmark"))
    _, e2 = A.replace_values(nodes, edges, words, VAL_P, SEED)
    return e2


@query("aug_schema", oracle=_duck_graph("SELECT DISTINCT qid, src, dst, label FROM e2", extra=f"""
{D.catalog_ctes()},
ac AS (SELECT DISTINCT db_id AS db2, table_name AS t2, column_name AS c2, column_type AS kind FROM cat WHERE db_id <> 'star'),
sz AS (SELECT db2, count(DISTINCT t2) AS n FROM ac GROUP BY db2),
qt AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY qid) AS m
       FROM (SELECT DISTINCT qid, val AS t FROM nodes WHERE type = 'TABLE')),
gr AS (SELECT DISTINCT qid, m FROM qt),
-- the eligible databases of a graph, largest first, and the one that its hash picks
el AS (SELECT gr.qid, sz.db2, sz.n, row_number() OVER (PARTITION BY gr.qid ORDER BY sz.n DESC, sz.db2) - 1 AS p,
              count(*) OVER (PARTITION BY gr.qid) AS e FROM gr JOIN sz ON sz.n >= gr.m),
db AS (SELECT qid, db2, n FROM el WHERE p = CAST(floor({D.uniform(str(SEED), "'db'", 'qid')} * e) AS BIGINT)),
ord AS (SELECT db2, t2, row_number() OVER (PARTITION BY db2 ORDER BY {D.uniform(str(SEED), "'tbl'", 'db2', 't2')}, t2) - 1 AS p
        FROM (SELECT DISTINCT db2, t2 FROM ac)),
tm AS (SELECT qt.qid, qt.t, db.db2, ord.t2 FROM qt JOIN db ON db.qid = qt.qid
       JOIN ord ON ord.db2 = db.db2 AND ord.p = (CAST(floor({D.uniform(str(SEED), "'tbloff'", 'qt.qid')} * db.n) AS BIGINT) + qt.i) % db.n),
cl AS (SELECT qid, node_id, val AS c, regexp_extract(node_id, '^COLUMN_([^.]*)[.]', 1) AS t FROM nodes WHERE type = 'COLUMN'),
cm AS (SELECT cl.qid, cl.node_id, cl.c, tm.t, tm.t2, s.column_type AS kind, {D.uniform(str(SEED), "'colorder'", 'cl.qid', 'cl.node_id')} AS h
       FROM cl JOIN tm ON tm.qid = cl.qid AND tm.t = cl.t
       LEFT JOIN cat s ON s.db_id = 'star' AND s.table_name = cl.t AND s.column_name = cl.c),
op AS (SELECT tm.qid, tm.t, ac.c2, ac.kind, {D.uniform(str(SEED), "'col'", 'tm.qid', 'tm.t2', 'ac.c2')} AS h
       FROM tm JOIN ac ON ac.db2 = tm.db2 AND ac.t2 = tm.t2),
ty AS (SELECT a.qid, a.t, a.node_id, b.c2 FROM
         (SELECT *, row_number() OVER (PARTITION BY qid, t, kind ORDER BY h, node_id) AS k FROM cm WHERE kind IS NOT NULL) a
         JOIN (SELECT *, row_number() OVER (PARTITION BY qid, t, kind ORDER BY h, c2) AS k FROM op) b
         ON b.qid = a.qid AND b.t = a.t AND b.kind = a.kind AND b.k = a.k),
re AS (SELECT *, row_number() OVER (PARTITION BY qid, t ORDER BY h, node_id) AS k FROM cm
       WHERE NOT EXISTS (SELECT 1 FROM ty WHERE ty.qid = cm.qid AND ty.node_id = cm.node_id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid, t ORDER BY h, c2) AS k FROM op
       WHERE NOT EXISTS (SELECT 1 FROM ty WHERE ty.qid = op.qid AND ty.t = op.t AND ty.c2 = op.c2)),
fo AS (SELECT qid, node_id, c2 FROM ty
       UNION ALL SELECT re.qid, re.node_id, fr.c2 FROM re LEFT JOIN fr ON fr.qid = re.qid AND fr.t = re.t AND fr.k = re.k),
mp AS (SELECT cm.qid, cm.node_id AS old_id, 'COLUMN_' || cm.t2 || '.' || coalesce(fo.c2, cm.c) AS new_id
       FROM cm JOIN fo ON fo.qid = cm.qid AND fo.node_id = cm.node_id
       UNION ALL SELECT qid, 'TABLE_' || t, 'TABLE_' || t2 FROM tm),
e2 AS (SELECT e.qid, coalesce(a.new_id, e.src) AS src, coalesce(b.new_id, e.dst) AS dst, e.label FROM edges e
       LEFT JOIN mp a ON a.qid = e.qid AND a.old_id = e.src LEFT JOIN mp b ON b.qid = e.qid AND b.old_id = e.dst)"""))
def q_aug_schema(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    cols = CAT.catalog_columns(spark, sf_dir)
    _, e2 = A.replace_schema(nodes, edges, cols.filter(F.col("db_id") == "star"), cols.filter(F.col("db_id") != "star"), SEED)
    return e2


_OPS_TOTAL = float(sum(A.OPERATOR_WEIGHTS.values()))


def _choice_sql() -> str:
    upto, cases = 0.0, []
    for op, w in A.OPERATOR_WEIGHTS.items():
        upto += w / _OPS_TOTAL
        cases.append(f"WHEN u < {upto!r}::DOUBLE THEN {D.lit(op)}")
    return f"CASE {' '.join(cases[:-1])} ELSE {D.lit(op)} END"


@query("choose_augmenters", oracle=f"""
WITH {D.QLOG_CTE}, p AS (SELECT qid, CAST(unnest(range(1, {N_AUG} + 1)) AS BIGINT) AS pick FROM qlog),
k AS (SELECT qid, pick, {D.uniform(str(SEED), "'op'", 'qid', 'pick')} AS u FROM p)
SELECT qid, {_choice_sql()} AS op, pick FROM k
""")
def q_choose_augmenters(spark, sf_dir):
    return A.choose_augmenters(S.qlog(spark, sf_dir).select("qid"), N_AUG, SEED)


@query("augment_positive")
def q_augment_positive(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    cols = CAT.catalog_columns(spark, sf_dir)
    ops = A.default_operators(SEED, A.word_list(S.load(spark, sf_dir, "benchmark")),
                              cols.filter(F.col("db_id") == "star"), cols.filter(F.col("db_id") != "star"))
    n2, _ = A.augment_positives(nodes, edges, A.sample_augmenters(nodes, N_AUG, SEED), ops)
    return n2


# --- pq-gram trees ----------------------------------------------------------------------------

from shotloom.operators import trees as TR  # noqa: E402

_TREE_SQL = """t0 AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS tree_id, role, text FROM conversations),
ln AS (SELECT tree_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM t0),
nodes0 AS (SELECT tree_id, '0' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(0 AS BIGINT) AS sib_a,
                  CAST(0 AS BIGINT) AS sib_b, role AS label FROM t0
           UNION ALL SELECT tree_id, CAST(pos + 1 AS VARCHAR), '0', CAST(pos AS BIGINT), CAST(0 AS BIGINT), trim(line)
           FROM ln WHERE length(trim(line)) > 0),
sp AS (SELECT nodes0.*, unnest(string_split(label, ' ')) AS part, generate_subscripts(string_split(label, ' '), 1) - 1 AS k,
              len(string_split(label, ' ')) AS n_parts FROM nodes0),
nodes1 AS (SELECT tree_id, node_id || '.' || CAST(k AS VARCHAR) AS node_id,
     CASE WHEN parent_id IS NULL AND n_parts > 1 THEN 'r' WHEN parent_id IS NULL THEN NULL ELSE parent_id || '.0' END AS parent_id,
     CAST(CASE WHEN parent_id IS NULL THEN k ELSE sib_a END AS BIGINT) AS sib_a,
     CAST(CASE WHEN parent_id IS NULL THEN 0 ELSE k END AS BIGINT) AS sib_b, part AS label FROM sp
   UNION ALL SELECT tree_id, 'r', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '*' FROM nodes0
   WHERE parent_id IS NULL AND len(string_split(label, ' ')) > 1),
par AS (SELECT tree_id, node_id AS pid, label AS plabel, parent_id AS gpid FROM nodes1),
kids AS (SELECT c.tree_id, c.parent_id, c.label, p.plabel, g.label AS gplabel,
            lag(c.label, 1) OVER w AS l1, lag(c.label, 2) OVER w AS l2, row_number() OVER w AS ci,
            count(*) OVER (PARTITION BY c.tree_id, c.parent_id) AS n
         FROM nodes1 c JOIN par p ON p.tree_id = c.tree_id AND p.pid = c.parent_id
              LEFT JOIN nodes1 g ON g.tree_id = c.tree_id AND g.node_id = p.gpid
         WHERE c.parent_id IS NOT NULL
         WINDOW w AS (PARTITION BY c.tree_id, c.parent_id ORDER BY c.sib_a, c.sib_b)),
leaves AS (SELECT n.tree_id, n.label, p.plabel AS up FROM nodes1 n
           LEFT JOIN par p ON p.tree_id = n.tree_id AND p.pid = n.parent_id
           WHERE NOT EXISTS (SELECT 1 FROM nodes1 c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id)),
grams AS (
  SELECT tree_id, concat_ws(chr(31), coalesce(gplabel, '*'), plabel, coalesce(l2, '*'), coalesce(l1, '*'), label) AS gram FROM kids
  UNION ALL SELECT tree_id, concat_ws(chr(31), coalesce(gplabel, '*'), plabel, coalesce(l1, '*'), label, '*') FROM kids WHERE ci = n
  UNION ALL SELECT tree_id, concat_ws(chr(31), coalesce(gplabel, '*'), plabel, label, '*', '*') FROM kids WHERE ci = n
  UNION ALL SELECT tree_id, concat_ws(chr(31), coalesce(up, '*'), label, '*', '*', '*') FROM leaves),
profile AS (SELECT tree_id, gram, CAST(count(*) AS BIGINT) AS mult FROM grams GROUP BY tree_id, gram)"""


def _split_trees(spark, sf_dir):
    return TR.tree_split(TR.turn_trees(S.load(spark, sf_dir, "conversations")), " ")


@query("tree_split", oracle=f"WITH {_TREE_SQL} SELECT * FROM nodes1")
def q_tree_split(spark, sf_dir):
    return _split_trees(spark, sf_dir)


@query("pqgram_profile", oracle=f"WITH {_TREE_SQL} SELECT * FROM profile")
def q_pqgram_profile(spark, sf_dir):
    return TR.pqgram_profile(_split_trees(spark, sf_dir))


@query("pqgram_distance", oracle=f"""WITH {_TREE_SQL},
pairs AS (SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS tree_a,
                 CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS tree_b
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant'),
sz AS (SELECT tree_id, CAST(sum(mult) AS BIGINT) AS n FROM profile GROUP BY tree_id),
j AS (SELECT pairs.tree_a, pairs.tree_b, sum(least(pa.mult, coalesce(pb.mult, 0))) AS inter,
             sum(CASE WHEN pb.mult IS NULL THEN 1 ELSE 0 END) AS missing
      FROM pairs JOIN profile pa ON pa.tree_id = pairs.tree_a
           LEFT JOIN profile pb ON pb.tree_id = pairs.tree_b AND pb.gram = pa.gram GROUP BY pairs.tree_a, pairs.tree_b)
SELECT p.tree_a, p.tree_b, coalesce(sa.n, 0) AS n_a, coalesce(sb.n, 0) AS n_b, CAST(coalesce(j.inter, 0) AS BIGINT) AS inter,
       round(CASE WHEN coalesce(sa.n, 0) + coalesce(sb.n, 0) = 0 THEN 0.0
                  ELSE 1.0 - 2.0 * coalesce(j.inter, 0) / (coalesce(sa.n, 0) + coalesce(sb.n, 0)) END, 6) AS distance,
       coalesce(sa.n, 0) = coalesce(sb.n, 0) AND coalesce(j.missing, 0) = 0 AS equal
FROM pairs p LEFT JOIN j ON j.tree_a = p.tree_a AND j.tree_b = p.tree_b
     LEFT JOIN sz sa ON sa.tree_id = p.tree_a LEFT JOIN sz sb ON sb.tree_id = p.tree_b
""")
def q_pqgram_distance(spark, sf_dir):
    c = S.load(spark, sf_dir, "conversations")
    key = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    pairs = (c.filter(F.col("role") == "user").select("conv_id", "turn")
              .join(c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn")),
                    ["conv_id", "turn"])
              .select(key(F.col("turn")).alias("tree_a"), key(F.col("turn") + 1).alias("tree_b")))
    return TR.pqgram_compare(TR.pqgram_profile(_split_trees(spark, sf_dir)), pairs)


# --- sources, sinks and batch completion ----------------------------------------------------

from shotloom.sources import files as FS  # noqa: E402
from shotloom.operators import complete as B  # noqa: E402


@query("union_pool", oracle="""
WITH u AS (SELECT 0 AS file_ord, doc_id AS src_id FROM documents UNION ALL SELECT 1, item_id FROM benchmark)
SELECT CAST(file_ord AS BIGINT) AS file_ord, src_id, CAST(row_number() OVER (ORDER BY file_ord, src_id) - 1 AS BIGINT) AS idx FROM u
""")
def q_union_pool(spark, sf_dir):
    a = S.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("src_id"))
    b = S.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("src_id"))
    return FS.union_pool([a, b], "src_id").select("file_ord", "src_id", "idx")


@query("load_splits", oracle="""
SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split,
       CAST(row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS BIGINT) AS idx, doc_id, text, source, lang
FROM documents
""")
def q_load_splits(spark, sf_dir):
    """``documents`` written as JSON Lines in three splits, then read with the places of the lines."""
    root = f"{checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
    docs = S.load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    paths = {}
    for k, split in enumerate(("train", "dev", "test")):
        paths[split] = f"{root}/{split}"
        FS.save_jsonl(docs.filter(F.col("doc_id") % 3 == k).repartitionByRange("doc_id").sortWithinPartitions("doc_id"), paths[split])
    return FS.load_splits(spark, {**paths, "extra": None}, docs.schema)


@schema_step("ddl_extract", oracle=f"""
WITH {D.catalog_ctes()},
scripts AS (SELECT db_id, replace(schema_text, chr(10) || ')', chr(10) || ');') AS text FROM schema_t),
ls AS (SELECT db_id, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM scripts),
l2 AS (SELECT *, sum(CASE WHEN starts_with(upper(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), 'CREATE TABLE') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY db_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM ls),
l3 AS (SELECT *, min(CASE WHEN contains(line, ';') THEN pos END) OVER (PARTITION BY db_id, sid) AS end_pos FROM l2 WHERE sid > 0)
SELECT db_id, CAST(sid - 1 AS BIGINT) AS stmt_idx,
       regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS statement
FROM l3 WHERE end_pos IS NOT NULL AND pos <= end_pos GROUP BY db_id, sid
""")
def q_ddl_extract(spark, sf_dir):
    sch = CAT.schema_text(CAT.catalog_columns(spark, sf_dir))
    scripts = sch.select("db_id", F.replace(F.col("schema_text"), F.lit("\n)"), F.lit("\n);")).alias("text"))
    return FS.extract_create_statements(scripts, key="db_id")


_ECHO_SQL = f"""
WITH {D.QLOG_CTE}, {D.catalog_ctes()},
r AS (SELECT qid, question, 'star' AS db_id, {D.postprocess('query')} AS sql FROM qlog),
pr AS (SELECT r.qid, r.sql, {D.lit(EC.rule_block(RULES))} || x.fields || 'Foreign_keys = ' || x.fk_list || chr(10)
       || 'Primary_keys = ' || x.pk_list || chr(10) || '#### Question: ' || r.question
       || chr(10) || '#### SQLite SQL QUERY' || chr(10) || r.sql || chr(10) || '#### SQLite FIXED SQL QUERY' || chr(10) || 'SELECT' AS prompt
       FROM r JOIN rendered x ON x.db_id = r.db_id),
resp AS (SELECT qid, sql AS raw, {D.postprocess('sql')} AS sql, true AS ok, CAST(1 AS BIGINT) AS attempts,
                {D.ntok('prompt')} + {D.ntok('sql')} AS total_tokens FROM pr)"""


def _responses(spark, sf_dir):
    return B.unchanged_responses(_correction_prompts(spark, sf_dir), id_col="qid", tokens_col="prompt_tokens")


@query("batch_complete", oracle=_ECHO_SQL + " SELECT * FROM resp")
def q_batch_complete(spark, sf_dir):
    return _responses(spark, sf_dir)


@query("completion_stats", oracle=_ECHO_SQL + """ SELECT CAST(count(*) AS BIGINT) AS n_questions,
  CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_failed, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(avg(total_tokens), 6) AS mean_tokens FROM resp""")
def q_completion_stats(spark, sf_dir):
    return B.completion_stats(_responses(spark, sf_dir))


# --- R6 structure-aware retrieval ---------------------------------------------------------------

def _struct_items(spark, sf_dir):
    sh = H.sql_shape(S.qlog(spark, sf_dir).select("qid", "question", "query"))
    tk = T.sql_tokens(F.col("query"))
    return sh.select("qid", T.tokens("question").alias("toks"), (F.col("n_setop") > 0).alias("setop"),
                     F.col("n_join").alias("jc"), (F.col("n_group") > 0).alias("g"),
                     F.array_contains(tk, "having").alias("h"), (F.col("n_order") > 0).alias("o"),
                     (F.col("n_limit") > 0).alias("l"))


def _struct_sql() -> str:
    sh = _shape_sql()
    body = sh[sh.index("WITH ") + 5:sh.index("\nSELECT *, CASE WHEN comp1")]
    return f"""WITH {body},
it AS (SELECT q.qid AS id, list_sort(list_distinct({D.toks('q.question')})) AS toks, cx.n_setop > 0 AS setop,
              least(cx.n_join, 3) AS jcb, cx.n_group > 0 AS g, list_contains({D.sql_toks('q.query')}, 'having') AS h,
              cx.n_order > 0 AS o, cx.n_limit > 0 AS l
       FROM qlog q JOIN cx ON cx.qid = q.qid),
sg AS (SELECT toks, setop, jcb, g, h, o, l, list(id ORDER BY id)[1:{K + 1}] AS mem FROM it GROUP BY ALL),
ts AS (SELECT *, CASE WHEN setop THEN 'conj' WHEN jcb = 1 THEN 'j1' WHEN jcb = 2 THEN 'j2' WHEN jcb >= 3 THEN 'j3' ELSE 'all' END AS bucket FROM sg),
ds AS (SELECT sg.*, b AS bucket FROM sg, unnest(['all', CASE WHEN setop THEN 'conj' END,
        CASE WHEN jcb = 1 THEN 'j1' WHEN jcb = 2 THEN 'j2' WHEN jcb >= 3 THEN 'j3' END]) AS u(b) WHERE b IS NOT NULL),
sc AS (SELECT t.toks AS ttoks, t.setop AS tsetop, t.jcb AS tjcb, t.g AS tg, t.h AS th, t.o AS t_o, t.l AS tl, d.mem,
         CASE WHEN len(list_distinct(list_concat(t.toks, d.toks))) = 0 THEN 0.0
              ELSE len(list_intersect(t.toks, d.toks))::DOUBLE / len(list_distinct(list_concat(t.toks, d.toks))) END
         + CASE WHEN t.g = d.g THEN 0.02 ELSE 0.0 END + CASE WHEN t.h = d.h THEN 0.01 ELSE 0.0 END
         + CASE WHEN t.o = d.o THEN 0.01 ELSE 0.0 END + CASE WHEN t.l = d.l THEN 0.01 ELSE 0.0 END AS score
       FROM ts t JOIN ds d ON d.bucket = t.bucket),
ex AS (SELECT ttoks, tsetop, tjcb, tg, th, t_o, tl, score, unnest(mem) AS did FROM sc),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ttoks, tsetop, tjcb, tg, th, t_o, tl ORDER BY score DESC, did) AS r
       FROM ex) WHERE r <= {K + 1}),
fin AS (SELECT it.id AS target_id, tp.did AS demo_id, tp.score FROM it JOIN tp
        ON tp.ttoks = it.toks AND tp.tsetop = it.setop AND tp.tjcb = it.jcb AND tp.tg = it.g AND tp.th = it.h
           AND tp.t_o = it.o AND tp.tl = it.l WHERE tp.did <> it.id)
SELECT target_id, demo_id, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, demo_id) AS BIGINT) AS rank FROM fin)
WHERE rank <= {K}"""


@query("retrieve_struct", oracle=_struct_sql())
def q_retrieve_struct(spark, sf_dir):
    return R.struct_retrieve(_struct_items(spark, sf_dir), K)


@query("sql_predicates", oracle=_shape_sql().replace(
    "SELECT *, CASE WHEN comp1 <= 1 AND others = 0 AND comp2 = 0 THEN 'easy'",
    "SELECT qid, n_or > 0 AS has_or, n_like > 0 AS has_like, n_nested > 0 AS has_sql, n_agg > 0 AS has_agg, "
    "CASE WHEN comp1 <= 1 AND others = 0 AND comp2 = 0 THEN 'easy'").replace(
    "ELSE 'extra' END AS hardness FROM cx", "ELSE 'extra' END AS hardness FROM cx"))
def q_sql_predicates(spark, sf_dir):
    c = H.complexity(H.sql_shape(S.qlog(spark, sf_dir).select("qid", "query")))
    return c.select("qid", (F.col("n_or") > 0).alias("has_or"), (F.col("n_like") > 0).alias("has_like"),
                    (F.col("n_nested") > 0).alias("has_sql"), (F.col("n_agg") > 0).alias("has_agg"), "hardness")


# --- survey key names for column subsets of the keys above --------------------------------------

def _subset(name: str, base: str, cols: list[str], where: str | None = None):
    base_sql = ORACLE[base]
    col_sql = ", ".join(cols)
    oracle = f"SELECT {col_sql} FROM ({base_sql}) AS b" + (f" WHERE {where}" if where else "")

    @query(name, oracle=oracle)
    def _q(spark, sf_dir):
        df = QUERIES[base](spark, sf_dir).select(*cols)
        return df.filter(where) if where else df
    return _q


_subset("pqgram_equal", "pqgram_distance", ["tree_a", "tree_b", "n_a", "n_b", "equal"])
_subset("complexity_counts", "complexity", ["qid", "n_where", "n_group", "n_order", "n_limit", "n_join", "n_or",
                                            "n_like", "n_nested", "n_setop", "n_agg", "n_select_cols",
                                            "n_where_conds", "n_group_cols", "comp1", "comp2", "others"])
_subset("complexity_label", "complexity", ["qid", "hardness"])


@query("budget_flags", oracle=f"""SELECT idx, length(prompt) = 0 AS is_empty, num_tokens > 4096 AS over_budget,
  num_tokens FROM ({ORACLE['prompt_build']}) AS b""")
def q_budget_flags(spark, sf_dir):
    """flag empty prompts and prompts over the 4096-token budget."""
    b = QUERIES["prompt_build"](spark, sf_dir)
    return b.select("idx", (F.length("prompt") == 0).alias("is_empty"),
                    (F.col("num_tokens") > 4096).alias("over_budget"), "num_tokens")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship: top-5 Jaccard demonstrations for every benchmark question."""
    return QUERIES["retrieve_jaccard"](spark, sf_dir)
