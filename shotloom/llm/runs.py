"""Op 11, periodic run detection: runs of repeated word blocks found on a Re-Pair grammar.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` periods
and ``LEAST`` words long, that no neighbouring word extends. Every document's word
ids are compressed by Re-Pair (the most frequent pair becomes a symbol until no pair
occurs twice). A run lies across the boundary of exactly one node of the derivation
tree, so each symbol's crossing runs are computed once, on its own expansion,
translated to every position where the symbol is derived, and merged to maximal
intervals per period.

A word that occurs fewer than ``EXPONENT`` times in its stretch of words is part of
no run; it ends the stretch, as a word of its own would in the grammar. Ordinary
prose leaves nothing to compress then. Documents are independent: nothing is
shuffled, and a task holds a few megabytes of text, or one longer text.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotloom.llm.base import WORD, slices

EXPONENT, LEAST = 4, 6
#: Text that is taken in one step.
STEP_BYTES = 1 << 20

Run = tuple[int, int, int]  # start, end, period


def repair(seq: list[int], first: int) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Rules ``symbol -> (left, right)``, numbered from ``first``, and the sequence they leave.

    Negative ids are separators that no rule takes in. Of equally frequent pairs the
    one with the shorter expansion goes first, which keeps the rules balanced.
    """
    n = len(seq)
    sym: list[int | None] = list(seq)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    length: dict[int, int] = {}
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
        if pair[0] >= 0 and pair[1] >= 0:
            where[pair].add(i)

    def entry(pair: tuple[int, int]) -> tuple:
        return -len(where[pair]), length.get(pair[0], 1) + length.get(pair[1], 1), pair

    heap = [entry(p) for p, at in where.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: dict[int, tuple[int, int]] = {}
    while heap:
        now = heapq.heappop(heap)
        pair = now[2]
        places = where[pair]
        if len(places) != -now[0]:
            if len(places) > 1:
                heapq.heappush(heap, entry(pair))
            continue
        new, touched = first + len(rules), set()
        rules[new] = pair
        length[new] = now[1]
        for i in sorted(places):
            j = after[i]
            if sym[i] != pair[0] or j >= n or sym[j] != pair[1]:
                continue  # overlaps an occurrence that was replaced, as in a a a
            left, right = before[i], after[j]
            if left >= 0 and sym[left] >= 0:
                where[sym[left], pair[0]].discard(left)
                where[sym[left], new].add(left)
                touched.add((sym[left], new))
            if right < n and sym[right] >= 0:
                where[pair[1], sym[right]].discard(j)
                where[new, sym[right]].add(i)
                touched.add((new, sym[right]))
            sym[i], sym[j], after[i] = new, None, right
            if right < n:
                before[right] = i
        del where[pair]
        for other in touched:
            if len(where[other]) > 1:
                heapq.heappush(heap, entry(other))
    return rules, [s for s in sym if s is not None]


def _z(v: list[int], upto: int) -> list[int]:
    """Length of the longest common prefix of ``v`` and ``v[i:]`` for i up to ``upto``."""
    n = len(v)
    out, left, right = [n] + [0] * upto, 0, 0
    for i in range(1, upto + 1):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and v[k] == v[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _half(v: list[int], b: int) -> list[Run]:
    """Runs across ``b`` with two periods at least to its right."""
    right = v[b:]
    upto = min(len(right) // 2, len(v) // EXPONENT)
    if upto < 1:
        return []
    out, known = [], []
    for q, z in enumerate(_z(right, upto)):
        if q == 0 or z < q or any(q % p == 0 and 2 * q <= end for p, end in known):
            continue
        known.append((q, q + z))
        s = b
        while s > 0 and v[s - 1] == v[s - 1 + q]:
            s -= 1
        if s < b and b + q + z - s >= max(LEAST, EXPONENT * q):
            out.append((s, b + q + z, q))
    return out


def crossing(v: list[int], b: int) -> list[Run]:
    """Runs of ``v`` that hold the words on both sides of boundary ``b``, maximal in ``v``.

    A run of at least four periods has two of them on one side of the boundary, so
    they are the squares that start there, read forwards or backwards.
    """
    n = len(v)
    if n < LEAST:
        return []
    back = [(n - e, n - s, q) for s, e, q in _half(v[::-1], n - b)]
    return list({*_half(v, b), *back})


class Grammar:
    """Expansions and crossing runs of the symbols of a Re-Pair grammar."""

    def __init__(self, rules: dict[int, tuple[int, int]]):
        self.rules = rules
        self.text: dict[int, list[int]] = {}
        #: for symbols with runs inside: (their own crossing runs, shifted parts that hold more)
        self.holds: dict[int, tuple[list[Run], list[tuple[int, int]]]] = {}
        for x, (a, b) in rules.items():  # parts are numbered before what they make
            left, right = self.expand(a), self.expand(b)
            v = self.text[x] = left + right
            inside = [(s, at) for s, at in ((a, 0), (b, len(left))) if s in self.holds]
            own = crossing(v, len(left))
            if own or inside:
                self.holds[x] = own, inside

    def expand(self, symbol: int) -> list[int]:
        return self.text.get(symbol) or [symbol]

    def derived(self, symbol: int, at: int) -> Iterator[Run]:
        """The runs of every symbol derived from ``symbol`` at word ``at``."""
        todo = [(symbol, at)] if symbol in self.holds else []
        while todo:
            x, off = todo.pop()
            own, inside = self.holds[x]
            yield from ((s + off, e + off, q) for s, e, q in own)
            todo += [(y, off + d) for y, d in inside]

    def runs(self, start: list[int]) -> list[Run]:
        """Maximal runs of a start sequence, whose symbols hang in a balanced tree."""
        lens = [len(self.expand(s)) for s in start]
        ends = np.cumsum(lens).tolist()
        text = [w for s in start for w in self.expand(s)]
        found = [r for s, n, end in zip(start, lens, ends, strict=True) for r in self.derived(s, end - n)]
        todo = [(0, len(start))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < 2:
                continue
            begin = ends[lo] - lens[lo]
            mid = min(max(bisect_left(ends, (begin + ends[hi - 1]) // 2, lo, hi) + 1, lo + 1), hi - 1)
            if ends[hi - 1] - begin >= LEAST:
                v = text[begin:ends[hi - 1]]
                found += [(s + begin, e + begin, q) for s, e, q in crossing(v, ends[mid - 1] - begin)]
                todo += [(lo, mid), (mid, hi)]
        return maximal(found)


def maximal(found: list[Run]) -> list[Run]:
    """Intervals that no other one of the same period holds, by start, then period."""
    out, last = [], (0, 0)
    for q, s, minus in sorted({(q, s, -e) for s, e, q in found}):
        if (q, -minus) > last:
            out.append((s, -minus, q))
            last = q, -minus
    return sorted((s, e, q) for s, e, q in out)


def runs_of(stretches: list[list[int]]) -> list[list[Run]]:
    """Runs of each stretch of one document's word ids, by one grammar for all of them."""
    seq = []
    for k, s in enumerate(stretches):
        seq += [*s, -k - 1]
    rules, start = repair(seq, max(seq) + 1)
    grammar, out, now = Grammar(rules), [], []
    for s in start:
        if s < 0:
            out.append(grammar.runs(now))
            now = []
        else:
            now.append(s)
    return out


def candidates(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that can hold a run.

    Words met fewer than ``EXPONENT`` times in their stretch end it, and stretches
    under ``LEAST`` words go, until nothing changes.
    """
    at, part = np.arange(len(ids)), owner.astype(np.int64)
    while True:
        if not len(at):
            return at, at
        _, back, n = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep = n[back] >= EXPONENT
        left, own = at[keep], part[keep]
        new = np.ones(len(left), bool)
        new[1:] = (np.diff(left) > 1) | (np.diff(own) != 0)
        label = np.cumsum(new) - 1
        long = np.bincount(label)[label] >= LEAST if len(left) else new
        if len(left) == len(at) and long.all():
            first = np.flatnonzero(new)
            return at[first], at[np.append(first[1:], len(at)) - 1] + 1
        at, part = left[long], label[long]


def step(texts: pa.Array) -> tuple[list, pa.Array]:
    """``(runs, collapsed text)`` of a few megabytes of texts."""
    words = pc.ascii_split_whitespace(texts)
    lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.cast(pa.large_string())
    blank = pc.index(names, pa.scalar("", pa.large_string())).as_py()  # white space at either end of a text
    owner = np.repeat(np.arange(len(texts)), lens)
    if blank >= 0:
        real = ids != blank
        ids, owner = ids[real], owner[real]
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    found: list[list[Run]] = [[] for _ in range(len(texts))]
    parts = defaultdict(list)
    for s, e in zip(*(x.tolist() for x in candidates(ids, owner)), strict=True):
        parts[int(owner[s])].append((s, e))
    keep = np.ones(len(ids), bool)
    for doc, spans in parts.items():
        base = int(begin[doc])
        for (at, _), runs in zip(spans, runs_of([ids[s:e].tolist() for s, e in spans]), strict=True):
            found[doc] += [(at - base + s, at - base + e, q) for s, e, q in runs]
            for s, e, q in runs:
                keep[at + s + q:at + e] = False
    kept = np.concatenate([[0], np.cumsum(keep)])[begin]
    lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), names.take(pa.array(ids[keep])))
    return [sorted(r) for r in found], pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, text: Column | str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``runs`` (array of start, length, period, in words) and ``collapsed``.

    ``runs`` are ordered by start, then period. ``collapsed`` is the text without the
    words that a run holds after its first period, joined by one space.

    A null text counts as empty: no runs, empty ``collapsed``. Rows are independent,
    so ties, repeated ids and repeated rows keep their own result, and an empty table
    gives none. A long text is a step of its own, whole. Columns of ``docs`` named
    ``runs`` or ``collapsed`` are replaced, all others stay.
    """
    names = [c for c in (keep or docs.columns) if c not in ("runs", "collapsed")]
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    sent = docs.select(*[docs[c] for c in names],
                       (F.col(text) if isinstance(text, str) else text).alias(f"_text_{uuid.uuid4().hex[:8]}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(names)), "")
            for at, n in slices(texts, STEP_BYTES):
                runs, collapsed = step(texts.slice(at, n))
                rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, n).columns[:-1], pa.array(rows, pa.list_(span)), collapsed.cast(texts.type)],
                    [*names, "runs", "collapsed"])

    more = T.StructType.fromDDL("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return sent.mapInArrow(run, T.StructType([*sent.schema.fields[:-1], *more.fields]))


def looped(doc_id: Column, text: Column) -> Column:
    """The contract's texts: for one id in ten, by its crc32, the words from a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        body = F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                           lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.when(n > 0, F.array_join(body, " ")).otherwise(text)

    # an array of one list of words, so that the words of a text are taken once and not for every word
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.transform(words, loop)[0]).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the one of greatest exponent, and digests of runs and collapsed text.

    Documents without doc_id are not looped. Columns as the operator's contract names them.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(plain, text=looped(F.col("doc_id"), F.col("text")), keep=["doc_id"])

    def better(best: Column, r: Column) -> Column:
        # length/period compared as whole numbers; earlier runs win ties
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
