"""Samples keep k picks a target at once; correction prompts come with their token counts."""

from pyspark.sql import functions as F

from shotloom.functions import hashing
from shotloom.functions import text as T
from shotloom.operators import complete as B
from shotloom.operators import correct as EC
from shotloom.operators import retrieve as R


def _brute(spark, rows, k, seed):
    u = {r.id: (r.g, r.u, r.s) for r in spark.createDataFrame(rows, "id long, g string").select(
        "id", "g", hashing.uniform(seed, F.col("id")).alias("u"), hashing.uniform(seed, "t", F.col("id")).alias("s")).collect()}
    out = set()
    for i, (g, _, s) in u.items():
        h = sorted(((x - s if x - s >= 0 else x - s + 1.0), j) for j, (o, x, _) in u.items() if o == g and j != i)
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(h[:k])}
    return out


def test_sample_writes_only_picks(spark, monkeypatch):
    tags, keep = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, tag: tags.append(tag) or keep(df, tag))
    rows = [(n, "abc"[n % 3] if n > 20 else f"only{n}") for n in range(700)] + [(900, "two"), (901, "two")]
    df = spark.createDataFrame(rows, "id long, g string")
    got = R.seeded_sample(df, df, 4, 3, target_id="id", pool_id="id", target_group="g", pool_group="g", exclude_self=True)
    assert {(r.target_id, r.demo_id, r["rank"]) for r in got.collect()} == _brute(spark, rows, 4, 3)
    assert "sample-candidates" not in tags


def test_sparse_buckets_are_widened(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_PICKS", 1)  # many targets lack picks in two buckets
    rows = [(n, "abc"[n % 3]) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = R.seeded_sample(df, df, 4, 3, target_id="id", pool_id="id", target_group="g", pool_group="g", exclude_self=True)
    assert {(r.target_id, r.demo_id, r["rank"]) for r in got.collect()} == _brute(spark, rows, 4, 3)


def test_prompt_tokens_are_known(spark):
    rendered = spark.createDataFrame([("d", "Table t, columns = [*,a_b]\n", "[t.a = u.b]", "[t.a]"), ("e", "", "[]", "[]")],
                                     "db_id string, fields string, fk_list string, pk_list string")
    rows = spark.createDataFrame([(1, "Wie viele?", "SELECT 'é' FROM t", "d"), (2, "", "", "e"), (3, None, "x", "d")],
                                 "idx long, question string, sql string, db_id string")
    prompts = EC.catalog_prompt(rows, rendered)
    counted = prompts.select("idx", "prompt_tokens", T.token_count("prompt").alias("n")).collect()
    assert len(counted) == 3 and all(r.prompt_tokens == r.n for r in counted)
    same = [B.unchanged_responses(prompts, tokens_col=c).orderBy("idx").collect() for c in (None, "prompt_tokens")]
    assert same[0] == same[1]
