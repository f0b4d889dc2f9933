import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import shotloom.llm.mixing as mixing
from shotloom.llm.packing import SIZES, best_fit, bin_cost, pack

from llm_cases import DOCS, clashing, hard_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mix(rows):
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    src = [r[3] for r in rows]
    names = sorted({s for s in src if s is not None}) + ([None] if None in src else [])
    total = sum(size)
    per = {s: sum(z for z, q in zip(size, src) if q == s) for s in names}
    w = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    goal, open_, rest = {}, set(names), float(total)
    while open_:
        rate = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if 3 * per[s] <= rate * w[s]}
        if not full:
            goal |= {s: rate * w[s] for s in open_}
            break
        goal |= {s: 3.0 * per[s] for s in full}
        rest -= sum(3 * per[s] for s in full)
        open_ -= full
    out = []
    for s in names:
        def key(r):
            text = [] if r[1] is None else [hashlib.md5(r[1].encode()).hexdigest()]
            return hashlib.md5("|".join(["mix-1"] + ([str(r[0])] if r[0] is not None else []) + text).encode()).hexdigest()

        mine = sorted((key(r), -1 if r[0] is None else r[0], z, r[0])
                      for r, z, q in zip(rows, size, src) if q == s)
        budget, before = int(goal[s] + 0.5), 0
        for _, _, z, i in mine:
            part = min(max(budget % max(1, per[s]) - before, 0), z)
            out.append((str(i), z, per[s], round(goal[s], 6), budget // max(1, per[s]) * z + part))
            before += z
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("slices", [1, 64])
def test_mix_matches_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(mixing, "MIN_SLICES", slices)
    rows = hard_docs()
    df = spark.createDataFrame(rows, DOCS)
    got = rows_of(mixing.mix(clashing(df)))
    assert got == brute_mix(rows) == rows_of(mixing.mix(df))


def test_rows_without_id_and_equal_rows_spread(spark):
    """Null ids fall into many slices, and any number of equal rows is one row until the cut."""
    rows = [(None, f"text number {i} " * (i % 4 + 1), "en", "s", 1) for i in range(600)] + [(7, "a b c", "en", "s", 1)] * 900
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(mixing.mix(df)) == brute_mix(rows)
    keys = df.select(mixing.row_key("mix-1").alias("h")).distinct()
    assert keys.count() == 601


def test_taken_sums_to_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), "en", f"s{min(9, int(rng.expovariate(0.5)))}", 1)
            for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken, goal = Counter(), {}
    src = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[src[r.doc_id]] += r.taken
        goal[src[r.doc_id]] = r.target
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
    assert abs(sum(goal.values()) - sum(r.size for r in got)) < 1e-6


def test_mixed_documents_repeat_whole_rows(spark):
    rows = hard_docs()
    df = spark.createDataFrame(rows, DOCS)
    plan = {}
    for i, z, per, goal, taken in brute_mix(rows):
        plan[i, z] = max(plan.get((i, z), 0), int(taken / z + 0.5) if z else 1)
    out = clashing(df)
    got = mixing.mixed_documents(out)
    assert got.columns == out.columns
    seen = Counter((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in got.collect())
    have = Counter((str(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    for k, n in have.items():
        assert abs(seen[k] - n * plan[k]) <= n, k


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 1)], DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def one_by_one(lengths, sizes):
    """Plain best-fit decreasing, a piece at a time, with the same rule for new bins."""
    left, todo = Counter(lengths), sorted(lengths, reverse=True)
    bins = []
    for n in todo:
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            smaller = {s: sum(k * c for k, c in left.items() if k < n and k <= s - n) for s in sizes if s >= n}
            same = left[n] * n
            size = min(smaller, key=lambda s: bin_cost(s) / min(s, min(same, s // n * n) + smaller[s]))
            b = [size, size]
            bins.append(b)
        b[0] -= n
        left[n] -= 1
    return sorted(size - room for room, size in bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_in_runs_equals_one_by_one(seed):
    rng = random.Random(seed)
    sizes = (16, 32, 64)
    lengths = [min(64, 1 + int(rng.expovariate(0.08))) for _ in range(rng.choice([1, 7, 60, 400]))]
    plan = best_fit(dict(Counter(lengths)), sizes)
    ends = list(plan.bins[1:, 0]) + [None]
    n_bins = max(r[2] for r in plan.runs.tolist()) + 1
    assert n_bins >= len(plan.bins) and plan.bins[:, 1].max() <= 64
    used = one_by_one(lengths, sizes)
    # bins of a run are equal; the total is what the pieces hold
    assert sum(used) == sum(lengths)
    total = 0
    for (first, content, size), end in zip(plan.bins.tolist(), ends):
        assert size == min(s for s in sizes if s >= content)
        if end is not None:
            total += (end - first) * content
    assert total <= sum(lengths)
    assert abs(len(used) - _bins(plan, lengths)) <= max(2, len(used) // 20)


def _bins(plan, lengths):
    """Number of bins, from the contents of the last run."""
    known = sum((b - a) * c for (a, c, _), (b, _, _) in zip(plan.bins.tolist(), plan.bins.tolist()[1:]))
    last, content, _ = plan.bins.tolist()[-1]
    return last + (sum(lengths) - known) // content


def check_packing(rows, got):
    by_bin, by_doc = defaultdict(list), Counter()
    for r in got:
        by_doc[r.doc_id] += r.length
        if r.length:
            by_bin[r.bin_id].append((r.bin_offset, r.length, r.bin_size, r.bin_used))
        else:
            assert r.bin_id is None
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(WORD.findall(t or ""))
    assert by_doc == want
    for b in by_bin.values():
        b.sort()
        end = 0
        for offset, n, _, _ in b:
            assert offset == end
            end += n
        assert {x[3] for x in b} == {end} and {x[2] for x in b} == {min(s for s in SIZES if s >= end)}
    return by_bin


def test_pack_every_piece_once(spark):
    rows = hard_docs()
    got = pack(clashing(spark.createDataFrame(rows, DOCS))).collect()
    check_packing(rows, got)
    assert sum(r.length == 0 for r in got) == sum(not WORD.findall(r[1] or "") for r in rows)
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_pack_real_documents_fills_bins(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins = check_packing([tuple(r) for r in df.collect()], pack(df).collect())
    assert sum(b[0][3] for b in bins.values()) / sum(b[0][2] for b in bins.values()) > 0.97
