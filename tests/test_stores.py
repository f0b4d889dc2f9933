"""Stores, the encoder hook, byte decoding and positive building."""

import glob
import os

import numpy as np
from pyspark.sql import functions as F

from shotloom.operators import augment as A
from shotloom.operators import content as V
from shotloom.sources import stores as ST


def test_encode_save_and_load(spark, tmp_path):
    pool = spark.createDataFrame([(i, f"text {i}" if i else None, f"db{i % 3}") for i in range(50)],
                                 "idx bigint, question string, db_id string")

    def encoder():
        return lambda texts: np.array([[len(t), i] for i, t in enumerate(texts)])

    ST.save_embeddings(ST.encode_pool(pool, encoder, batch=7), str(tmp_path / "vec"))
    back = ST.load_embeddings(spark, str(tmp_path / "vec"))
    rows = {r.id: (r.db_id, list(r.vec)) for r in back.collect()}
    assert len(rows) == 50 and all(v[0] == f"db{i % 3}" and v[1][0] == (len(f"text {i}") if i else 0) and v[1][1] < 7
                                   for i, v in rows.items())
    some = ST.load_embeddings(spark, str(tmp_path / "vec"), ["db1"])
    assert {r.db_id for r in some.collect()} == {"db1"}
    assert "PartitionFilters: [isnotnull(db_id" in some._jdf.queryExecution().toString() or some.count() == 17


def test_content_index_store(spark, tmp_path):
    rows = [("d1", "t", "c", "x", "text"), ("d2", "t", "c", "y", "text"), ("d2", "u", "c", " Z ", "text")]
    df = spark.createDataFrame(rows, "db_id string, table_name string, column_name string, value string, value_type string")
    path = str(tmp_path / "ci")
    ST.save_content_index(df, path)
    assert sorted(map(tuple, ST.load_content_index(spark, path).collect())) == rows
    assert ST.load_content_index(spark, path, ["d2"]).count() == 2
    # one table's part replaced, the others untouched
    ST.save_content_index(df.filter("table_name = 'u'").withColumn("value", F.lit("new")), path)
    assert sorted(r.value for r in ST.load_content_index(spark, path).collect()) == ["new", "x", "y"]


def test_every_scalar_type_is_indexed(spark):
    import datetime as dt
    rows = [(1, 2.50, "a", True, dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 60), [1], bytearray(b"x"), 10.0),
            (1, float("nan"), None, None, None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, day date, at timestamp, l array<int>, raw binary, z double")
    got = {(r.column_name, r.value, r.value_type) for r in V.table_index(df, "db", "t").collect()}
    assert got == {("i", "1", "number"), ("d", "2.5", "number"), ("d", "NaN", "number"), ("s", "a", "text"), ("b", "true", "boolean"),
                   ("day", "2020-01-02", "time"), ("at", "2020-01-02 03:04:05.000060", "time"), ("z", "10", "number"), ("z", "0", "number")}
    assert V.table_index(spark.createDataFrame([([1],)], "l array<int>"), "db", "t") is None


def test_update_scans_changed_tables_only(spark, tmp_path):
    path = str(tmp_path / "index")

    def write(table, values):
        spark.createDataFrame([(v,) for v in values], "c string").write.mode("overwrite").parquet(str(tmp_path / table))

    def tables(*names):
        return [("d", t, spark.read.parquet(str(tmp_path / t))) for t in names]

    def stored(**kw):
        return {(r.table_name, r.value) for r in ST.load_content_index(spark, path, **kw).collect()}

    for t, values in (("a", ["x", "y"]), ("b", ["z", "z"]), ("c", ["w"])):
        write(t, values)
    assert ST.update_content_index(spark, path, tables("a", "b", "c")) == [("d", "a"), ("d", "b"), ("d", "c")]
    assert stored() == {("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")}
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(path + "/db_id=d/table_name=[ac]/*.parquet")}
    assert ST.update_content_index(spark, path, tables("a", "b", "c")) == []
    write("b", ["new"])
    assert ST.update_content_index(spark, path, tables("a", "b", "c")) == [("d", "b")]
    assert stored() == {("a", "x"), ("a", "y"), ("b", "new"), ("c", "w")}
    assert before == {f: os.stat(f).st_mtime_ns for f in glob.glob(path + "/db_id=d/table_name=[ac]/*.parquet")}
    write("c", [])
    assert ST.update_content_index(spark, path, tables("b", "c")) == [("d", "c")]  # c became empty, a is gone
    assert stored() == {("b", "new")}


def test_keys_are_pushed_into_the_scan(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "keyed")
    df = spark.range(5000).select(F.lit("d").alias("db_id"), F.lit("t").alias("table_name"), F.lit("c").alias("column_name"),
                                  F.concat(F.lit(" V"), F.col("id")).alias("value"), F.lit("text").alias("value_type"))
    ST.save_content_index(df, path)
    keys = spark.createDataFrame([("v7",), ("v4999",), ("none",)], "_key string")
    few = ST.load_content_index(spark, path, ["d"], keys)
    assert sorted(r.value for r in few.collect()) == [" V4999", " V7"]
    plan = few._jdf.queryExecution().toString()
    assert "In(key, [" in plan and "PartitionFilters" in plan
    monkeypatch.setattr(ST, "PUSHED_KEYS", 1)
    assert sorted(r.value for r in ST.load_content_index(spark, path, keys=keys).collect()) == [" V4999", " V7"]


def test_log_databases_and_repair_of_a_log(spark):
    catalog = spark.createDataFrame([("shop", "Items"), ("zoo", "animals"), ("zoo", "items")], "db_id string, table_name string")
    log = spark.createDataFrame([
        (1, "db1", "SELECT a FROM Items WHERE b = 'red '"), (2, "db1", 'SELECT a FROM items WHERE b = "Blue"'),
        (3, "db2", "SELECT a FROM animals, items WHERE b = 'LION' AND c = '5'"), (4, "db3", "SELECT 1"), (5, "db3", "x = 'red'"),
        (6, None, None)], "qid long, db_id string, query string")
    means = V.log_databases(log, catalog)
    assert {tuple(r) for r in means.collect()} == {("db1", "shop"), ("db2", "zoo")}
    index = spark.createDataFrame([("shop", "Red", "text"), ("shop", "red", "text"), ("shop", "blue", "text"), ("zoo", "Lion", "text"),
                                   ("zoo", "5", "number")], "db_id string, value string, value_type string")
    got = {r.qid: (r.repaired, r.changed) for r in V.repair_log(log.join(means, "db_id", "left"), index).collect()}
    assert got[1] == ("SELECT a FROM Items WHERE b = 'Red'", True) and got[2] == ("SELECT a FROM items WHERE b = 'blue'", True)
    assert got[3] == ("SELECT a FROM animals, items WHERE b = 'Lion' AND c = '5'", True)
    assert got[4] == ("SELECT 1", False) and got[5] == ("x = 'red'", False) and got[6] == (None, False)


def test_decode_bytes_by_first_encoding(spark):
    raw = ["ğüş".encode(), "ğüş".encode("windows-1254"), b"\x81\x8d", None, b""]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raw)],
                               "i int, b binary")
    got = {r.i: r.b for r in ST.decode_bytes(df, "b").collect()}
    assert got == {0: "ğüş", 1: "ğüş", 2: b"\x81\x8d".decode("iso-8859-9"), 3: None, 4: ""}


def test_choices_follow_the_weights(spark):
    graphs = spark.range(4000).select(F.col("id").alias("qid"))
    got = A.choose_augmenters(graphs, 3, 1).groupBy("op").count().collect()
    share = {r.op: r["count"] / 12000 for r in got}
    total = sum(A.OPERATOR_WEIGHTS.values())
    assert all(abs(share[op] - w / total) < 0.03 for op, w in A.OPERATOR_WEIGHTS.items())


def test_positives_apply_assigned_operators_in_order(spark):
    nodes = spark.createDataFrame([(q, n, n, "SQL_KEYWORD" if n != "ROOT" else "ROOT") for q in (1, 2, 3)
                                   for n in ("ROOT", "A", "B")], "qid long, node_id string, val string, type string")
    edges = spark.createDataFrame([(q, "ROOT", n, "has") for q in (1, 2, 3) for n in ("A", "B")],
                                  "qid long, src string, dst string, label string")
    ops = {"mark": lambda n, e: (n.withColumn("val", F.concat("val", F.lit("+"))), e),
           "cut": lambda n, e: (n.filter("node_id <> 'B'"), e.filter("dst <> 'B'")),
           "mask": lambda n, e: (n.withColumn("aug_text", F.when(F.col("node_id") == "A", "<mask>")), e)}
    assigned = spark.createDataFrame([(1, "mark", 1), (1, "mark", 2), (2, "mask", 1), (2, "cut", 2)],
                                     "qid long, op string, pick long")
    n2, e2 = A.augment_positives(nodes, edges, assigned, ops)
    got = {(r.qid, r.node_id): (r.val, r.aug_text) for r in n2.collect()}
    assert got[1, "A"] == ("A++", None) and got[2, "A"] == ("A", "<mask>") and (2, "B") not in got
    assert got[3, "A"] == ("A", None) and len(got) == 8 and e2.count() == 5


def test_overlay_without_a_file_and_with_a_short_one(spark):
    from shotloom.operators.prep import overlay_preliminary
    gold = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, query string")
    assert [(r.query, r.gold_query) for r in overlay_preliminary(gold, None, ["idx"]).collect()] == [("", "a"), ("", "b")]
    short = spark.createDataFrame([(0, "x")], "idx long, prelim_query string")
    assert sorted((r.query, r.gold_query) for r in overlay_preliminary(gold, short, ["idx"]).collect()) == [("b", "b"), ("x", "a")]
