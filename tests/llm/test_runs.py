import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shotloom.llm.runs import Grammar, crossing, looped, maximal, periodic_runs, repair, run_digests, runs_of, step
from pyspark.sql import functions as F

from llm_cases import DOCS, clashing, hard_docs

SPACE = " \t\n\v\f\r"


def words_of(text):
    for c in SPACE[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(w):
    """Every maximal stretch of each period, smallest periods first."""
    code = {x: k for k, x in enumerate(dict.fromkeys(w))}
    ids, out = np.array([code[x] for x in w]), []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1) + q):
            if e - s >= max(6, 4 * q) and not any(q % p == 0 and a <= s and e <= b for a, b, p in out):
                out.append((int(s), int(e), q))
    return sorted(out)


def plain_digest(doc_id, text):
    w = words_of(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


blocks = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(blocks)
def test_step_matches_every_period(parts):
    w = [x for block, times in parts for x in block * times]
    runs, collapsed = step(pa.array(["  ".join(w), "\n" + "\t".join(w) + " ", ""]))
    assert runs[0] == runs[1] == plain_runs(w) and runs[2] == []
    gone = {i for s, e, q in runs[0] for i in range(s + q, e)}
    assert collapsed.to_pylist() == [" ".join(x for i, x in enumerate(w) if i not in gone)] * 2 + [""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_grammar_derives_its_text(seq):
    rules, start = repair(seq, 10)
    grammar = Grammar(rules)
    assert [w for s in start for w in grammar.expand(s)] == seq
    pairs = [p for p in zip(start, start[1:])]
    assert all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)
    assert grammar.runs(start) == plain_runs(seq)


def test_each_symbol_is_searched_once():
    loop = list(range(50)) * 64
    rules, start = repair(loop, 1000)
    assert len(rules) < 60 and runs_of([loop]) == [[(0, 3200, 50)]]
    assert crossing([1] * 4 + [2], 2) == [] and crossing([1] * 6, 2) == [(0, 6, 1)]
    assert maximal([(0, 8, 2), (2, 8, 2), (0, 12, 3), (20, 26, 2)]) == [(0, 8, 2), (0, 12, 3), (20, 26, 2)]


def test_separate_stretches_share_a_grammar():
    a, b = [1, 2, 3] * 5, [2, 3, 1] * 4 + [7, 7]
    assert runs_of([a, b]) == [plain_runs(a), plain_runs(b)]


def test_long_documents(spark):
    rng = random.Random(4)
    cases = [["a"] * 150_000, rng.choices("abcd", k=40_000), [f"w{i}" for i in range(9000)] * 5,
             (["a"] * 300 + ["b"]) * 60]
    for w in cases:
        runs, _ = step(pa.array([" ".join(w)]))
        assert all(w[s:e - q] == w[s + q:e] for s, e, q in runs[0])
        if len(set(w)) != 4:
            assert max(runs[0], key=lambda r: r[1] - r[0])[:2] == (0, len(w))
    assert step(pa.array([" ".join(cases[1][:3000])]))[0][0] == plain_runs(cases[1][:3000])


def test_digests_on_hard_documents(spark):
    rng = random.Random(5)
    rows = hard_docs()
    for i in range(200, 330):  # every tenth id or so is looped
        rows.append((i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 90)) * rng.randint(1, 5)), "en", "s", 1))
    rows += [(400, "buy now " * 2000, None, None, 0), (400, "buy now " * 2000, None, None, 0), (401, "  x" * 9, None, None, 0)]
    got = run_digests(clashing(spark.createDataFrame(rows, DOCS).repartition(3)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_digest(r[0], r[1]) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got.collect()) > 40


def test_columns_stay_and_text_may_be_any_column(spark):
    df = spark.createDataFrame([(1, "x x x x x x y", "old"), (2, None, None)], "id long, body string, runs string")
    got = periodic_runs(clashing(df), text="body").orderBy("id").collect()
    assert [tuple(r) for r in got[0].runs] == [(0, 6, 1)] and got[0].collapsed == "x y" and got[0].key == "extra"
    assert got[1].runs == [] and got[1].collapsed == ""
    assert run_digests(spark.createDataFrame([], DOCS)).count() == 0
    same = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert same.select(looped(F.col("doc_id"), F.col("text")).alias("t")).first().t == "a b"
