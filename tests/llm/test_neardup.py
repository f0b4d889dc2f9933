import random

import pytest

import shotloom.llm.neardup as nd
from shotloom.llm.components import components

from llm_cases import DOCS, clashing, hard_docs


def brute(rows, width, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width
                    else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            same = rows[a][0] == rows[b][0]
            if same or 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    low = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            low[find(a)] = min(low.get(find(a), r[0]), r[0])
    return sorted((str(r[0]), len(sets[a]), str(low.get(find(a)) if r[0] is not None else None))
                  for a, r in enumerate(rows))


def near_groups(n_groups, size, seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    rows, k = [], 100
    for g in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([30, 120]))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w), "en", "s", 1))
            k += 1
    shared = " ".join(rng.choices(vocab, k=25))
    rows += [(k + i, " ".join(rng.choices(vocab, k=60)) + " " + shared, "en", "s", 1) for i in range(40)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("width,percent,block", [(3, 85, 256), (3, 85, 8), (5, 80, 8)])
def test_components_match_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(nd, "SET_BLOCK", block)
    monkeypatch.setattr(nd, "LIST_BLOCK", 2 * block)
    rows = near_groups(4, 40, seed=width + block)
    assert result(nd.near_duplicates(spark.createDataFrame(rows, DOCS), width, percent)) == brute(rows, width, percent)


def test_edges(spark):
    rows = hard_docs()
    got = nd.near_duplicates(clashing(spark.createDataFrame(rows, DOCS)))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())
    assert nd.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 4999), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1100))
    assert got[5000] == 4999 and len(got) == 301 + 100 + 2


def test_threshold_misses_rarely():
    assert nd.matches_needed(85) == 16 and nd.matches_needed(80) < 16 < nd.matches_needed(95)


def test_a_class_is_confirmed_with_its_own_text(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    a, b, c, d = (" ".join(w) for w in words)
    near = [" ".join(w[:-1] + ["z"]) for w in words]
    rows = [(1, a), (1, None), (1, b), (2, near[1]), (3, near[0]), (4, c), (4, d), (4, None), (5, near[3])]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        full = [(*r, "en", "s", 1) for r in order]
        assert result(nd.near_duplicates(spark.createDataFrame(full, DOCS).coalesce(1))) == brute(full, 3, 85)
