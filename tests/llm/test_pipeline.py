import re
import zlib
from collections import Counter

import corpus_pipeline as cp
from shotloom.llm.base import stored, table
from shotloom.llm.pii import ANY

from llm_cases import DOCS, clashing, hard_docs
from test_mixing_packing import brute_mix, check_packing
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    cols = docs.columns
    rows = [tuple(r) for r in docs.collect()]

    known = stored(cp.language(spark, docs, SF), "t")
    assert known.columns == cols
    one = [tuple(r) for r in known.collect()]
    assert sorted(one) == sorted(r for r in rows if any(map(str.isalpha, r[1])))

    single = stored(cp.near_dedup(spark, known, SF), "t")
    two = [tuple(r) for r in single.collect()]
    keep = {i for i, _, root in brute(one, 5, 80) if i == root}
    assert sorted(str(r[0]) for r in two) == sorted(keep) and set(two) <= set(one)

    safe = stored(cp.private(spark, single, SF), "t")
    three = [tuple(r) for r in safe.collect()]
    assert safe.columns == cols and sorted(r[0] for r in three) == sorted(r[0] for r in two)
    was = {r[0]: r for r in two}
    for r in three:
        assert r[4] == len(r[1])
        if r[1] != was[r[0]][1]:
            assert re.search(r"[0-9@]", was[r[0]][1])

    mixed = stored(cp.mixture(spark, safe, SF), "t")
    four = [tuple(r) for r in mixed.collect()]
    want = Counter()
    for i, z, _, _, taken in brute_mix(three):
        want[i] = int(taken / z + 0.5) if z else 1
    assert Counter(str(r[0]) for r in four) == +want and set(four) <= set(three)

    check_packing(four, cp.packing(spark, mixed, SF).collect())


def test_run_is_repeatable(spark):
    a, b = (sorted(map(str, cp.run(spark, SF).collect())) for _ in range(2))
    assert a == b and len(a) > 100
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "pii", "mixing", "packing"]


def test_stages_survive_hard_rows(spark):
    rows = hard_docs()
    base = spark.createDataFrame(rows, DOCS)
    for docs in (base, clashing(base), base.limit(0)):
        at = stored(docs, "t")
        for _, stage in cp.STAGES[:-1]:
            nxt = stored(stage(spark, at, SF), "t")
            assert nxt.columns == docs.columns
            at = nxt
        assert cp.packing(spark, at, SF).count() >= 0


def test_dedup_keeps_one_row_of_a_repeated_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (9, text + " x", "en", "s", 1), (None, text, "en", "s", 1)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert Counter(r.doc_id for r in got) == {5: 1, None: 1}


def test_private_leaves_nothing_of_a_mention(spark):
    rows = [(1, "write to a.b@c.org now", "en", "s", 22), (2, "clean", "en", "s", 5)]
    got = {r.doc_id: r for r in cp.private(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert got[2].text == "clean" and "a.b@c.org" not in got[1].text and re.search(r"\S@\S", got[1].text)
    assert "@" in ANY


def test_dedup_judges_rows_that_share_an_id_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, None), (2, b + " x"), (3, a + " x"), (4, c), (1, a), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (1, None), (4, c), (5, None)], key=str)


def test_unlabelled_documents_pass_the_language_stage(spark):
    rows = [(1, "Ein Satz.", None, "s", 9), (2, "12 34 !!", None, "s", 8), (3, None, None, "s", 0), (4, "", None, "s", 0),
            (None, "кот", None, "s", 3), (5, "漢字", None, None, 2)]
    got = cp.language(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if r[0] not in (2, 3, 4)), key=str)
    held = [(k, "some words", "en", "s", 10) for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and cp.language(spark, spark.createDataFrame(held, DOCS), SF).count() == len(held)


def test_dedup_of_rows_without_source_or_language(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (9, text + " x"), (7, "other")]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(tuple(r) for r in got) == [(5, text), (7, "other")]
