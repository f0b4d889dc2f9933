"""Replacement of tables and columns from any database that is large enough."""

from shotloom.operators import augment as A

COLS = "db_id string, table_name string, column_name string, column_type string"
SOURCE = [("own", t, f"{t}{i}", "number" if i % 2 else "text") for t in ("a", "b", "c") for i in range(4)]
#: Databases of one, two and three tables; small has fewer columns than a source table.
OTHERS = ([("small", "s", c, "text") for c in ("s0", "s1")]
          + [("mid", t, f"{t}{i}", "number" if i < 3 else "text") for t in ("m", "n") for i in range(5)]
          + [("big", t, f"{t}{i}", "text" if i < 3 else "number") for t in ("x", "y", "z") for i in range(6)])


def swapped(spark, graphs, seed=3):
    nodes, edges = [], []
    for qid, tables in enumerate(graphs):
        nodes.append((qid, "ROOT", "ROOT", "ROOT"))
        for t in tables:
            nodes.append((qid, f"TABLE_{t}", t, "TABLE"))
            for i in range(4):
                nodes.append((qid, f"COLUMN_{t}.{t}{i}", f"{t}{i}", "COLUMN"))
                edges.append((qid, f"COLUMN_{t}.{t}{i}", f"TABLE_{t}", "belongs_to"))
    n, e = A.replace_schema(spark.createDataFrame(nodes, "qid long, node_id string, val string, type string"),
                            spark.createDataFrame(edges, "qid long, src string, dst string, label string"),
                            spark.createDataFrame(SOURCE, COLS), spark.createDataFrame(OTHERS, COLS), seed)
    out = {q: set() for q in range(len(graphs))}
    for r in e.collect():
        out[r.qid].add((r.src, r.dst))
    count = {}
    for r in n.collect():
        count[r.qid] = count.get(r.qid, 0) + 1
    return out, count


def test_tables_and_columns_map_one_to_one(spark):
    graphs = [("a",)] * 60 + [("a", "b")] * 60 + [("a", "b", "c")] * 20 + [("a", "b", "c", "d")] * 5
    edges, count = swapped(spark, graphs)
    db_of = {t: d for d, t, _, _ in OTHERS}
    kinds = {f"COLUMN_{t}.{c}": k for _, t, c, k in OTHERS}
    used = {1: set(), 2: set(), 3: set()}
    for qid, tables in enumerate(graphs):
        now = {d[len("TABLE_"):] for _, d in edges[qid]}
        assert len(now) == len(tables) and len(edges[qid]) == 4 * len(tables)  # nothing fell together
        assert count[qid] == 1 + 5 * len(tables)
        if len(tables) == 4:
            assert now == set(tables)  # no database has four tables
            continue
        assert len({db_of[t] for t in now}) == 1
        used[len(tables)] |= {db_of[t] for t in now}
        for t in now:
            got = [kinds.get(s) for s, d in edges[qid] if d == f"TABLE_{t}"]
            if db_of[t] == "big":
                assert sorted(got) == ["number", "number", "text", "text"]  # each within its type
            elif db_of[t] == "mid":
                assert sorted(got) in (["number", "number", "number", "text"], ["number", "number", "text", "text"])
            else:
                assert sorted(map(str, got)) == ["None", "None", "text", "text"]  # two keep their names
    assert used == {1: {"small", "mid", "big"}, 2: {"mid", "big"}, 3: {"big"}}


def test_no_replacement_at_all(spark):
    nodes = spark.createDataFrame([(1, "TABLE_a", "a", "TABLE")], "qid long, node_id string, val string, type string")
    edges = spark.createDataFrame([], "qid long, src string, dst string, label string")
    n, e = A.replace_schema(nodes, edges, spark.createDataFrame(SOURCE, COLS), spark.createDataFrame([], COLS), 1)
    assert [r.node_id for r in n.collect()] == ["TABLE_a"] and e.count() == 0
