"""Golden cases (FIXTURES section 5) and properties of the operators."""

import math

from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.operators import content as V
from shotloom.operators import correct as EC
from shotloom.operators import prompt as PR
from shotloom.operators import retrieve as R
from shotloom.operators import trees as TR


def _tree(spark, tree_id, edges, labels):
    """edges: child -> (parent, position); labels: node -> label."""
    rows = []
    for node, label in labels.items():
        parent, pos = edges.get(node, (None, 0))
        rows.append((tree_id, node, parent, pos, 0, label))
    return spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, sib_a bigint, "
                                       "sib_b bigint, label string")


def test_pqgram_single_node(spark):
    prof = TR.pqgram_profile(_tree(spark, "t", {}, {"0": "a"})).collect()
    assert [(r.gram.split(TR.SEP), r.mult) for r in prof] == [(["*", "a", "*", "*", "*"], 1)]


def test_pqgram_known_trees_distance(spark):
    e = {"1": ("0", 0), "2": ("1", 0), "3": ("1", 1), "4": ("0", 1), "5": ("0", 2)}
    t1 = _tree(spark, "t1", e, {"0": "a", "1": "a", "2": "e", "3": "b", "4": "b", "5": "c"})
    t2 = _tree(spark, "t2", e, {"0": "a", "1": "a", "2": "e", "3": "b", "4": "b", "5": "x"})
    prof = TR.pqgram_profile(t1.unionByName(t2))
    sizes = {r.tree_id: r.n for r in prof.groupBy("tree_id").agg(F.sum("mult").alias("n")).collect()}
    assert sizes == {"t1": 13, "t2": 13}
    pairs = spark.createDataFrame([("t1", "t2")], "tree_a string, tree_b string")
    r = TR.pqgram_compare(prof, pairs).collect()[0]
    assert r.inter == 9
    assert math.isclose(r.distance, round(1 - 18 / 26, 6))
    assert r.equal is False


def test_tree_split_children_go_to_first_part(spark):
    t = _tree(spark, "t", {"1": ("0", 0)}, {"0": "a-b", "1": "c"})
    out = {r.node_id: (r.parent_id, r.label) for r in TR.tree_split(t, "-").collect()}
    assert out["r"] == (None, "*")
    assert out["0.0"] == ("r", "a") and out["0.1"] == ("r", "b")
    assert out["1.0"] == ("0.0", "c")


def test_jaccard_pair_golden_and_properties(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], []), (["x"], ["x", "x"])],
                               "a array<string>, b array<string>")
    got = [r.j for r in df.select(R.jaccard_pair(F.col("a"), F.col("b")).alias("j")).collect()]
    assert got == [0.5, 0.0, 1.0]
    sym = [r.j for r in df.select(R.jaccard_pair(F.col("b"), F.col("a")).alias("j")).collect()]
    assert sym == got and all(0.0 <= x <= 1.0 for x in got)


def test_jaccard_backfill_and_ties(spark):
    t = spark.createDataFrame([(1, ["a"]), (2, [])], "idx bigint, toks array<string>")
    p = spark.createDataFrame([(10, ["z"]), (11, ["a", "b"]), (12, ["q"]), (13, ["a"])], "idx bigint, toks array<string>")
    out = sorted((r.target_id, r.rank, r.demo_id, r.score) for r in R.jaccard(t, p, 3).collect())
    assert out == [(1, 1, 13, 1.0), (1, 2, 11, 0.5), (1, 3, 10, 0.0),
                   (2, 1, 10, 0.0), (2, 2, 11, 0.0), (2, 3, 12, 0.0)]


def test_structure_class_golden(spark):
    df = spark.createDataFrame([("select a from t join u",), ("select a from t union select b from u",),
                                ("select count(*) from t join u",), ("select a from t group by a",),
                                ("select a from t",)], "q string")
    got = [r.c for r in df.select(R.structure_class(T.sql_tokens("q")).alias("c")).collect()]
    assert got == ["join", "conjunction", "easy", "aggr", "easy"]


def test_sampling_independent_of_partitioning(spark):
    t = spark.range(0, 50).withColumnRenamed("id", "idx")
    p = spark.range(0, 400).withColumnRenamed("id", "idx")
    a = sorted(map(tuple, R.seeded_sample(t, p, 5, 7).collect()))
    b = sorted(map(tuple, R.seeded_sample(t.repartition(7), p.repartition(3), 5, 7).collect()))
    assert a == b and len(a) == 250
    assert all(len({r[1] for r in a if r[0] == i}) == 5 for i in range(50))


def test_packing_stops_at_first_overflow(spark):
    d = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 2)], "target_id bigint, rank bigint, cost bigint")
    kept = PR.pack(d, F.lit(8), F.col("cost"), mode="section").filter("kept").select("rank").collect()
    assert [r.rank for r in kept] == [1]


def test_packing_never_over_budget(spark):
    import random
    rnd = random.Random(3)
    rows = [(t, r, rnd.randint(0, 30)) for t in range(40) for r in range(1, 8)]
    d = spark.createDataFrame(rows, "target_id bigint, rank bigint, cost bigint")
    for mode in ("section", "sep_each", "flat"):
        k = PR.pack(d, F.lit(50), F.col("cost"), mode=mode, sep_tokens=F.lit(1), fixed=F.lit(3))
        tot = k.filter("kept").groupBy("target_id").agg(F.sum("cost").alias("c"), F.count("*").alias("n"))
        for r in tot.collect():
            extra = {"section": 3 + (r.n - 1), "sep_each": 3 + r.n, "flat": r.n - 1}[mode]
            assert r.c + extra <= 50


def test_price_golden(spark):
    rows = spark.createDataFrame([(1000,)], "n_tokens bigint")
    got = {r.model: r.total_cost for r in PR.cost_report(rows, ["gpt-4", "nope"]).collect()}
    assert got == {"gpt-4": 0.03, "nope": None}


def test_literal_repair_golden_and_idempotent(spark):
    vals = spark.createDataFrame([("d", "BUILDING"), ("d", "kept")], "db_id string, value string")
    var = V.value_variants(vals)
    rows = spark.createDataFrame([(1, "d", 'SELECT a FROM t WHERE x = "building "'),
                                  (2, "d", "SELECT a FROM t WHERE x = \"kept\""),
                                  (3, "d", "SELECT 1")], "qid bigint, db_id string, query string")
    out = {r.qid: (r.repaired, r.changed) for r in V.repair_literals(rows, vals, var).collect()}
    assert out[1] == ("SELECT a FROM t WHERE x = 'BUILDING'", True)
    assert out[2] == ("SELECT a FROM t WHERE x = 'kept'", False)
    assert out[3] == ("SELECT 1", False)
    again = rows.select("qid", "db_id", F.col("qid").alias("_q")).join(
        V.repair_literals(rows, vals, var).select("qid", F.col("repaired").alias("query")), "qid")
    out2 = {r.qid: r.repaired for r in V.repair_literals(again.select("qid", "db_id", "query"), vals, var).collect()}
    assert out2 == {k: v[0] for k, v in out.items()}


def test_clean_golden(spark):
    df = spark.createDataFrame([("a > = 1",), ("SELECT 1 /* x */",), ("```sql\nselect  x\n```",)], "q string")
    got = df.select(T.join_split_ops("q").alias("a"), T.postprocess_sql(F.col("q")).alias("b")).collect()
    assert got[0].a == "a >= 1"
    assert got[1].b == "SELECT 1"
    assert got[2].b == "select x"


def test_rule_block_golden():
    text = EC.rule_block([1, 3])
    numbered = [ln for ln in text.splitlines() if ln[:1].isdigit()]
    assert len(numbered) == 9 and numbered[0].startswith("1) ") and numbered[-1].startswith("9) ")
    assert EC.rule_block(99).endswith("SQL QUERY:\n\n")


def test_fk_render_empty_is_brackets(spark):
    from shotloom.sources import catalog as C
    cols = spark.createDataFrame([("db", 0, "t", 1, "a", "text", "TEXT", 1)],
                                 "db_id string, table_idx bigint, table_name string, col_idx bigint, "
                                 "column_name string, column_type string, ddl_type string, ordinal bigint")
    r = EC.render_catalog(cols).collect()[0]
    assert r.fk_list == "[]" and r.pk_list == "[]"
    assert r.fields == "Table t, columns = [*,a]\n"
    assert C.LOGICAL_DBS["vec"] == ["embeddings"]


def test_percentile_negatives_golden(spark):
    from shotloom.operators import contrast as N
    anchors = spark.createDataFrame([(0, "a", [1.0, 0.0])], "vec_id bigint, db_id string, embedding array<float>")
    pool_rows = [(0, "a", [1.0, 0.0])] + [(i, "b", [math.cos(i / 10), math.sin(i / 10)]) for i in range(1, 11)]
    pool = spark.createDataFrame(pool_rows, "vec_id bigint, db_id string, embedding array<float>")
    out = N.neg_percentile(anchors, pool, seed=1).collect()
    ranks = {i: 10 - i for i in range(1, 11)}  # ascending similarity: id 10 is rank 0
    hard = [ranks[r.neg_id] for r in out if r.band == "hard"]
    easy = [ranks[r.neg_id] for r in out if r.band == "easy"]
    assert len(hard) == 2 and all(3 <= x <= 5 for x in hard)
    assert len(easy) == 3 and all(0 <= x <= 2 for x in easy)


def test_safe_delete_keeps_shared_nodes(spark):
    from shotloom.operators import augment as A
    nodes = spark.createDataFrame([(1, n, "X") for n in ["ROOT", "S", "W", "C", "T", "V"]],
                                  "qid bigint, node_id string, type string").withColumn(
        "type", F.when(F.col("node_id") == "ROOT", "ROOT").otherwise(F.col("type")))
    edges = spark.createDataFrame([(1, "ROOT", "S"), (1, "S", "W"), (1, "W", "C"), (1, "C", "T"),
                                   (1, "S", "T"), (1, "W", "V")], "qid bigint, src string, dst string")
    tg = spark.createDataFrame([(1, "W")], "qid bigint, node_id string")
    n2, _ = A.subgraph_delete(nodes, edges, tg)
    assert sorted(r.node_id for r in n2.collect()) == ["ROOT", "S", "T"]


def test_ddl_extract_single_line_and_multi(spark):
    from shotloom.sources import files as FS
    s = spark.createDataFrame([(1, "-- x\nCREATE TABLE a (x int);\nCREATE TABLE b (\n  y int\n);\njunk")],
                              "doc_id bigint, text string")
    got = sorted((r.stmt_idx, r.statement) for r in FS.extract_create_statements(s).collect())
    assert got == [(0, "CREATE TABLE a (x int);"), (1, "CREATE TABLE b (\n  y int\n);")]


def test_txt_records_positions(spark, tmp_path):
    from shotloom.sources import files as FS
    p = tmp_path / "r.txt"
    p.write_text("SELECT 1\n\n  SELECT 2  \n")
    got = sorted((r.pos, r.line) for r in FS.load_txt_records(spark, str(p)).collect())
    assert got == [(0, "SELECT 1"), (1, ""), (2, "SELECT 2")]


def test_jsonl_round_trip(spark, tmp_path):
    from shotloom.sources import files as FS
    df = spark.createDataFrame([(1, "a", [1, 2])], "idx bigint, prompt string, ids array<bigint>")
    FS.save_jsonl(df, str(tmp_path / "out"))
    back = FS.load_jsonl(spark, str(tmp_path / "out"), "idx bigint, prompt string, ids array<bigint>")
    assert back.collect() == df.collect()
    (tmp_path / "arr.json").write_text('[{"question": "q1", "db_id": "d"}, {"question": "q2", "db_id": "d"}]')
    assert FS.load_json_records(spark, str(tmp_path / "arr.json")).count() == 2


def test_batch_complete_retries_and_failures(spark):
    from shotloom.operators import complete as B

    class Flaky:
        def __call__(self, prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            return "SELECT 1", 3

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "idx bigint, prompt string")
    out = {r.idx: r for r in B.batch_complete(df, Flaky, attempts=3, backoff_s=0).collect()}
    assert out[1].ok and out[1].sql == "SELECT 1" and out[1].attempts == 1
    assert not out[2].ok and out[2].sql is None and out[2].attempts == 3


def test_sampling_exact_whatever_the_window(spark):
    t = spark.range(0, 60).withColumnRenamed("id", "idx").withColumn("g", F.col("idx") % 3)
    p = spark.range(0, 90).withColumnRenamed("id", "idx").withColumn("g", F.col("idx") % 3)
    kw = dict(target_group="g", pool_group="g", exclude_self=True)
    a = sorted(map(tuple, R.seeded_sample(t, p, 5, 11, start_window=1, **kw).collect()))
    b = sorted(map(tuple, R.seeded_sample(t, p, 5, 11, start_window=64, **kw).collect()))
    assert a == b and len(a) == 300


def test_not_toggle_adds_and_removes(spark):
    from shotloom.operators import augment as A
    nodes = spark.createDataFrame(
        [(1, "ROOT", "ROOT", "ROOT"), (1, "W", "WHERE", "SQL_KEYWORD"), (1, "SQL_KEYWORD_NOT_0", "NOT", "SQL_KEYWORD"),
         (1, "SQL_KEYWORD_IN_0", "IN", "SQL_KEYWORD"), (2, "ROOT", "ROOT", "ROOT"), (2, "W", "WHERE", "SQL_KEYWORD"),
         (2, "SQL_KEYWORD_LIKE_0", "LIKE", "SQL_KEYWORD")], "qid bigint, node_id string, val string, type string")
    edges = spark.createDataFrame(
        [(1, "ROOT", "W", "x"), (1, "W", "SQL_KEYWORD_NOT_0", "e"), (1, "SQL_KEYWORD_NOT_0", "SQL_KEYWORD_IN_0", "e"),
         (2, "ROOT", "W", "x"), (2, "W", "SQL_KEYWORD_LIKE_0", "e")], "qid bigint, src string, dst string, label string")
    n2, e2 = A.toggle_not(nodes, edges, 1.0, 5)
    got = sorted((r.qid, r.src, r.dst) for r in e2.collect())
    assert got == [(1, "ROOT", "W"), (1, "W", "SQL_KEYWORD_IN_0"),
                   (2, "ROOT", "W"), (2, "SQL_KEYWORD_NOT_0", "SQL_KEYWORD_LIKE_0"), (2, "W", "SQL_KEYWORD_NOT_0")]
    assert sorted(r.node_id for r in n2.filter("qid = 1").collect()) == ["ROOT", "SQL_KEYWORD_IN_0", "W"]


def test_schema_replacement_keeps_types(spark):
    from shotloom.operators import augment as A
    nodes = spark.createDataFrame(
        [(1, "ROOT", "ROOT", "ROOT"), (1, "TABLE_t", "t", "TABLE"), (1, "COLUMN_t.n", "n", "COLUMN"),
         (1, "COLUMN_t.s", "s", "COLUMN")], "qid bigint, node_id string, val string, type string")
    edges = spark.createDataFrame([(1, "ROOT", "TABLE_t", "FROM"), (1, "COLUMN_t.n", "TABLE_t", "belongs_to"),
                                   (1, "COLUMN_t.s", "TABLE_t", "belongs_to")], "qid bigint, src string, dst string, label string")
    src = spark.createDataFrame([("t", "n", "number"), ("t", "s", "text")], "table_name string, column_name string, column_type string")
    aug = spark.createDataFrame([("d", "u", "a", "text"), ("d", "u", "b", "number"), ("d", "u", "c", "text")],
                                "db_id string, table_name string, column_name string, column_type string")
    n2, e2 = A.replace_schema(nodes, edges, src, aug, 3)
    ids = {r.node_id for r in n2.collect()}
    assert "TABLE_u" in ids and "COLUMN_u.b" in ids
    assert ({"COLUMN_u.a", "COLUMN_u.c"} & ids) and "TABLE_t" not in ids
    assert all(r.dst == "TABLE_u" for r in e2.filter("label = 'belongs_to'").collect())


def test_execute_candidates(spark):
    from conftest import SF_SMALL
    from shotloom.operators import complete as B
    from shotloom.sources.tables import register_all
    register_all(spark, SF_SMALL)
    c = spark.createDataFrame([(1, "SELECT r_name FROM region"), (2, "SELECT nope FROM region"),
                               (3, "SELECT r_name FROM region")], "idx bigint, sql string")
    out = {r.idx: r for r in B.execute_candidates(c).collect()}
    assert out[1].status == "result" and out[1].n_rows == 5 and out[1].columns == "r_name" and out[1].valid == 1
    assert out[2].status == "exception" and out[2].valid == 0 and out[2].error
    assert out[3].n_rows == 5


def test_dot_topk_does_not_depend_on_blocks(spark, monkeypatch):
    from conftest import SF_SMALL
    from shotloom.sources.tables import load
    e = load(spark, SF_SMALL, "embeddings")
    kw = dict(target_id="vec_id", target_vec="embedding", pool_id="vec_id", pool_vec="embedding", exclude_self=True)
    a = sorted(map(tuple, R.dot_topk(e, e, 4, **kw).collect()))
    monkeypatch.setattr(R, "TARGET_BLOCK", 90)
    monkeypatch.setattr(R, "POOL_BLOCK", 70)
    monkeypatch.setattr(R, "TILE", 7)
    b = sorted(map(tuple, R.dot_topk(e, e, 4, **kw).collect()))
    assert a == b and len(a) == 4 * e.count()


def test_complexity_counts_the_outer_query(spark):
    from shotloom.operators import complexity as H
    cases = [
        ("SELECT a FROM t WHERE x IN (SELECT y FROM u WHERE c = 1 OR d = 2)", 1, 1, 0, "hard"),
        ("SELECT a FROM t WHERE x BETWEEN 1 AND 5", 1, 0, 0, "easy"),
        ("SELECT a FROM t, u WHERE t.x = u.y", 2, 0, 0, "medium"),
        ("SELECT a FROM t WHERE x = 'this or that, and like (select'", 1, 0, 0, "easy"),
        ("SELECT a FROM t WHERE x > 1 UNION SELECT b FROM u WHERE c = 1 OR d LIKE 'x'", 1, 1, 0, "hard"),
        ("SELECT count(*), max(a) FROM t GROUP BY b, c", 1, 0, 3, "hard"),
        ("SELECT a FROM (SELECT b, c FROM u WHERE d = 1) AS v", 0, 0, 0, "easy"),
        ("SELECT substr(a, 1, 2) FROM t JOIN u ON t.x = u.y ORDER BY b LIMIT 3", 3, 0, 0, "hard"),
        ("SELECT a FROM t WHERE x IN (SELECT y FROM u WHERE z IN (SELECT w FROM v)) AND q = 2", 1, 1, 1, "extra"),
        ("SELECT a FROM t WHERE NOT x = 1 AND NOT y = 2", 1, 0, 2, "medium"),
        ("SELECT a FROM t GROUP BY a HAVING count(*) > 1 OR sum(b) > 2", 2, 0, 0, "medium"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "qid long, query string")
    got = {r.qid: r for r in H.complexity(H.sql_shape(df)).collect()}
    for i, (sql, one, two, others, label) in enumerate(cases):
        r = got[i]
        assert (r.comp1, r.comp2, r.others, r.hardness) == (one, two, others, label), sql


def test_jaccard_salted_fallback_equals_broadcast(spark):
    from conftest import SF_SMALL
    from shotloom.functions import text as T
    from shotloom.sources import tables as S
    t = S.targets(spark, SF_SMALL).withColumn("toks", T.tokens("question"))
    p = S.pool(spark, SF_SMALL).withColumn("toks", T.tokens("question"))
    a = sorted(map(tuple, R.jaccard(t, p, 5).collect()))
    spark.conf.set("shotloom.broadcast.maxRows", "1")
    try:
        b = sorted(map(tuple, R.jaccard(t, p, 5).collect()))
    finally:
        spark.conf.unset("shotloom.broadcast.maxRows")
    assert a == b and len(a) == 5 * t.count()


def test_complexity_counts_no_commas_of_nested_calls(spark):
    from shotloom.operators import complexity as H
    cases = [("SELECT coalesce(a, abs(b), c) FROM t", 1, 0, 0), ("SELECT f(g(h(i(a, b), c), d), e), x FROM t", 2, 0, 0),
             ("SELECT a FROM t, u GROUP BY coalesce(a, round(abs(b), 2), c), d", 1, 2, 1)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "qid long, query string")
    got = {r.qid: r for r in H.sql_shape(df).collect()}
    for i, (sql, cols, groups, joins) in enumerate(cases):
        assert (got[i].n_select_cols, got[i].n_group_cols, got[i].n_join) == (cols, groups, joins), sql


def test_unchanged_responses_are_the_queries_asked_about(spark):
    from shotloom.operators import complete as B
    rows = [(1, "### Fix\n#### SQLite SQL QUERY\nselect  a from t\n#### SQLite FIXED SQL QUERY\nSELECT"), (2, "no headings"), (3, None), (4, "")]
    got = {r.idx: r for r in B.unchanged_responses(spark.createDataFrame(rows, "idx long, prompt string")).collect()}
    assert (got[1].raw, got[1].sql, got[1].ok, got[1].attempts) == ("select  a from t", "select a from t", True, 1)
    assert got[1].total_tokens == 24 + 4 and got[2].raw == "no headings" and got[2].total_tokens == 4
    assert got[3].raw is None and got[3].sql == "SELECT " and got[3].total_tokens == 0 and got[4].raw == ""
