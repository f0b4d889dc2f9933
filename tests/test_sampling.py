"""Negatives from other databases against a sort of the whole pool per anchor."""

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from shotloom.operators import contrast as N
from shotloom.operators import retrieve as R


def uniform(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def plain(anchors, pool, n, seed):
    out = set()
    for i, db in anchors:
        s = uniform(seed, "t", i)
        others = sorted(((uniform(seed, j) - s) % 1.0 if uniform(seed, j) < s else uniform(seed, j) - s, j)
                        for j, other in pool if other != db)
        out |= {(i, j, slot) for slot, (_, j) in enumerate(others[:n], 1)}
    return out


@pytest.mark.parametrize("shape", ["hot", "even", "single", "tiny"])
def test_negatives_of_other_databases(spark, shape):
    rng = random.Random(2)
    dbs = {"hot": lambda i: "big" if i % 100 else f"db{i % 3}", "even": lambda i: f"db{i % 7}", "single": lambda i: "only",
           "tiny": lambda i: None if i % 3 == 0 else "x"}[shape]
    size = 9 if shape == "tiny" else 1500
    pool = [(i, dbs(i)) for i in range(size)]
    anchors = [(i, dbs(i)) for i in rng.sample(range(size), min(size, 300))] + [(10_000, "elsewhere"), (10_001, None)]
    schema = "vec_id long, db_id string"
    got = N.neg_uniform(spark.createDataFrame(anchors, schema), spark.createDataFrame(pool, schema).repartition(5), 5, 42)
    assert {tuple(r) for r in got.collect()} == plain(anchors, pool, 5, 42)


def test_rows_do_not_grow_with_a_hot_database(spark, monkeypatch):
    """Every running sum sees the pool and targets x k rows, whichever database dominates."""
    seen = []
    original = R.ordered_prefix
    monkeypatch.setattr(R, "ordered_prefix", lambda df, *a, **k: (seen.append(df.count()), original(df, *a, **k))[1])
    schema = "vec_id long, db_id string"
    pool = spark.createDataFrame([(i, "big" if i % 200 else "small") for i in range(4000)], schema)
    anchors = pool.filter("vec_id < 400")
    assert N.neg_uniform(anchors, pool, 5, 1).count() == 2000
    assert max(seen) <= 4000 + 400 * 5 and len(seen) == 3


def test_no_rows(spark):
    schema = "vec_id long, db_id string"
    some, none = spark.createDataFrame([(1, "a")], schema), spark.createDataFrame([], schema)
    assert N.neg_uniform(some, none, 5, 1).count() == N.neg_uniform(none, some, 5, 1).count() == 0
    assert N.neg_uniform(some, some, 0, 1).count() == 0


def plain_struct(items, k):
    """Every pair in a bucket, scored on whole sets."""
    out = set()
    for i, toks, setop, jc, *flags in items:
        ranked = []
        for j, other, s2, j2, *flags2 in items:
            inside = s2 if setop else (min(jc, 3) == min(j2, 3) if jc >= 1 else True)
            if i == j or not inside:
                continue
            both = len(set(toks) | set(other))
            bonus = sum(v for v, a, b in zip((0.02, 0.01, 0.01, 0.01), flags, flags2) if a == b)
            ranked.append((-round((len(set(toks) & set(other)) / both if both else 0.0) + bonus, 9), j))
        out |= {(i, j, r) for r, (_, j) in enumerate(sorted(ranked)[:k], 1)}
    return out


ITEMS = "qid long, toks array<string>, setop boolean, jc long, g boolean, h boolean, o boolean, l boolean"


def test_structure_retrieval_matches_all_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(words, k=rng.randint(0, 9)) + ["the", "of"], rng.random() < 0.1, rng.choice([0, 0, 1, 2, 5]),
              *[rng.random() < 0.4 for _ in range(4)]) for i in range(220)]
    items += [(300 + i, [], False, 1, True, True, True, True) for i in range(5)] + [(400, items[0][1], *items[0][2:])]
    got = R.struct_retrieve(spark.createDataFrame(items, ITEMS), 4).collect()
    assert {(r.target_id, r.demo_id, r["rank"]) for r in got} == plain_struct(items, 4)


def test_stop_tokens_of_a_bucket_are_not_multiplied(spark, monkeypatch):
    """Questions with common words and a theme each: the pairs scored follow the themes, not the bucket's square."""
    n, per = 1200, 6
    items = [(i, ["the", "of", "how", "many"] + [f"theme{i // per}-{j}" for j in range(6)] + [f"own{i}"], False, 0, False, False,
              False, False) for i in range(n)]
    seen = []
    original = R.struct_pairs
    monkeypatch.setattr(R, "struct_pairs", lambda *a: (seen.append(original(*a).count()), original(*a))[1])
    got = R.struct_retrieve(spark.createDataFrame(items, ITEMS), 3).collect()
    assert len(got) == 3 * n and all(r.target_id // per == r.demo_id // per for r in got)
    assert seen[0] <= 4 * per * n < n * n / 20


def test_equal_scores_are_not_all_paired(spark, monkeypatch):
    """Questions that differ in one token all score the same: only those with smaller ids than the k-th known come back."""
    n = 400
    items = [(i, ["how", "many", "of", f"own{i}"], False, i % 2, i % 3 == 0, False, False, i % 5 == 0) for i in range(n)]
    seen = []
    original = R.struct_pairs
    monkeypatch.setattr(R, "struct_pairs", lambda *a: (seen.append(original(*a).count()), original(*a))[1])
    got = R.struct_retrieve(spark.createDataFrame(items, ITEMS), 3).collect()
    assert {(r.target_id, r.demo_id, r["rank"]) for r in got} == plain_struct(items, 3)
    assert seen[0] < n * n / 20


def test_features_are_computed_once(spark):
    """The signatures' join reads stored features: its null check does not run them again in the scan's one task."""
    met = spark.sparkContext.accumulator(0)

    def seen(x):
        met.add(1)
        return x

    items = spark.createDataFrame([(i, ["a", f"b{i}"], False, 0, False, False, False, False) for i in range(40)], ITEMS).repartition(2)
    toks = F.udf(seen, "array<string>")("toks")
    R.struct_retrieve(items.withColumn("toks", toks), 2).collect()
    assert met.value == 40
