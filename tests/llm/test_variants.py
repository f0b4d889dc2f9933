import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotloom.llm import variants
from shotloom.llm.variants import document_variants, follow, near_words, spelling_variants, word_counts

from llm_cases import DOCS, clashing, hard_docs


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying them all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts):
    form, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], counts.get(form[w])))
    return rows


def plain_counts(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def as_set(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def random_words(seed, letters, k, sizes):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.choice(sizes))): rng.choice([3, 5, 8, 30, 200]) for _ in range(k)}


@pytest.mark.parametrize("block", [1024, 8])
def test_tiles_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    counts = random_words(1, "ab", 250, [5, 6, 7, 8]) | random_words(2, "aéÿ漢", 150, [1, 2, 3, 4, 30])
    counts |= {"x" * 3000: 3, "x" * 2999 + "y": 6, "x" * 3001: 12, "x" * 3003: 30}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_set(spelling_variants(df)) == plain_variants(counts)
    sent = near_words(df).groupBy("word").count().count()
    assert sent == sum(r[4] > 0 for r in plain_variants(counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 9), min_size=1, max_size=25))
def test_one_bucket(words):
    import numpy as np
    import pyarrow as pa
    rows = []
    for w, n in words.items():
        for m in (len(w), len(w) + 1):
            for k in range(4):
                b, e = m * k // 4, m * (k + 1) // 4
                if b < e:
                    rows.append((w, n, m, k, hash((m, k, w[:b], w[len(w) - (m - e):]))))
    cols = list(zip(*rows))
    zero = np.zeros(len(rows), np.int64)
    got = variants.near_in_tiles(pa.table({"word": list(cols[0]), "n": list(cols[1]), "m": list(cols[2]),
                                           "piece": list(cols[3]), "key": list(cols[4]), "tile": zero, "block": zero}))
    want = {w: [v for v in words if one_edit(w, v)] for w in words}
    assert {(r["word"], r["n_near"], r["form"], r["form_n"]) for r in got.to_pylist()} == {
        (w, len(v), *min(((x, words[x]) for x in v), key=lambda p: (-p[1], p[0]))) for w, v in want.items() if v}


def test_words_of_hard_documents(spark):
    rows = hard_docs()
    rng = random.Random(9)
    vocab = ["naïveté", "größer", "straße", "éclair", "letters", "letter", "lettersé", "ÀÉÎÕÜ", "a×b÷c", "short"]
    rows += [(100 + i, " ".join(rng.choices(vocab, k=60)) + rng.choice([" O'Neills", "_under_score9line ", "\n"]),
              "en", "s", 1) for i in range(150)]
    rows += [(None, "letters letters Letters nothingĀother", None, None, None)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = {tuple(r) for r in word_counts(docs, drop_every=97).collect()}
    assert got == set(plain_counts(rows).items()) and len(got) == 20
    assert as_set(document_variants(docs)) == plain_variants(plain_counts(rows))


def test_counter_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTER_WORDS", 10)
    rows = [(i, "alpha beta gamma delta epsilon " * 2 + f"word{'abcdefghij'[i % 10] * 3}", None, None, 0) for i in range(60)]
    got = {r.word: r.n for r in word_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert got["alpha"] == 120 and got["wordaaa"] == 6 and "beta" not in got


def test_long_chains_repeats_and_empty_tables(spark):
    counts = {"aaaaa" + "b" * i: 2 ** (i + 2) for i in range(30)}
    rows = list(counts.items())
    df = spark.createDataFrame(rows + [(None, 3), ("zzzzz", None)], "word string, n long")
    got = {r.word: r.root for r in spelling_variants(clashing(df)).collect()}
    assert set(got) == set(counts) and set(got.values()) == {"aaaaa" + "b" * 29}
    twice = spark.createDataFrame([("words", 2), ("words", 2), ("wordss", 8)], "word string, n long")
    assert as_set(spelling_variants(twice)) == plain_variants({"words": 4, "wordss": 8})
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(empty).count() == 0
    assert document_variants(spark.createDataFrame([], DOCS)).count() == 0
    hub = spark.createDataFrame([(f"w{i}", "hub") for i in range(500)] + [("hub", "top")], "word string, form string")
    assert {r.root for r in follow(hub).collect()} == {"top"}
