"""Op 4, quality classifier: Bradley-Terry scores learnt from preference pairs.

A pair prefers a document of label 1 to one of label 0; the weights maximise the
logistic likelihood of the pairs on feature differences. Scores are then laid on 0
to 1 by their quantiles among the training documents, so that the quantile that
separates the labels best falls on ``THRESHOLD``.

Training takes every labelled document: its features are written once, it is in at
least one pair, and moments, Newton sums, quantiles and the cut are sums or counts over
all of them in Spark. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import as_bytes, crc_mod, join_small_side, small_batches, stored
from shotloom.operators.common import dense_index

#: PAIRS: the fewest pairs; with more documents every one is in a pair.
THRESHOLD, PAIRS, STEPS, RIDGE, GRID = 0.3, 60_000, 25, 1e-3, 2001
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes and marks, word lengths, and how often words and lines repeat."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, n_words, n_lines = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum())
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    distinct = len(set(words))
    base = [
        hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / n, hist[128:].sum() / n, hist[_MARKS].sum() / n,
        hist[10] / n, hist[_SPACE].sum() / n, (len(text) - hist[_SPACE].sum()) / n_words / 20,
        distinct / n_words, (n_words - distinct) / n_words, same / n_words, len(set(lines)) / n_lines,
        np.log1p(len(words)) / 10, np.log1p(n_words / n_lines) / 8, float(not words), np.log1p(n_lines) / 8,
    ]
    marks = hist[_MARKS] / n_words
    x = np.array(base + marks.tolist())
    return np.concatenate([x, np.sqrt(x), np.minimum(1, 10 * x[:12])])


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts])


@dataclass
class Ranker:
    """Scaled weights, the grid of training scores and the quantile put on THRESHOLD."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    grid: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: the training quantile, stretched so that the cut is THRESHOLD."""
        s = self.raw(x)
        q = np.interp(s, self.grid, np.linspace(0, 1, len(self.grid)))
        edge = self.grid[int(round(self.cut * (len(self.grid) - 1)))]
        low = THRESHOLD * np.minimum(q / max(self.cut, 1e-9), 1 - 1e-9)
        high = THRESHOLD + (1 - THRESHOLD) * np.maximum(0, q - self.cut) / max(1 - self.cut, 1e-9)
        return np.where(s >= edge, high, low)


def newton_sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the pairwise logistic likelihood, summed over the pairs, in one row."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
    return np.concatenate([diff.T @ (1 - p), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], n_pairs: int, width: int) -> np.ndarray:
    """Weights by Newton steps, from the sums over all pairs at each step's weights."""
    w = np.zeros(width)
    for _ in range(STEPS):
        total = sums(w) / n_pairs
        grad = total[:width] - RIDGE * w
        curve = total[width:].reshape(width, width) + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, grad)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(good_below: np.ndarray, bad_below: np.ndarray, n_good: int, n_bad: int) -> float:
    """The quantile that passes the most good and stops the most bad, from the counts below each grid score."""
    gain = (1 - good_below / n_good) + bad_below / n_bad
    return float(int(gain.argmax()) / (GRID - 1))


def fit(good: np.ndarray, bad: np.ndarray) -> Ranker | None:
    """The model of features in memory, on PAIRS drawn pairs; None unless both labels occur."""
    if not len(good) or not len(bad):
        return None
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    good, bad = (good - mean) / scale, (bad - mean) / scale
    rng = np.random.default_rng(11)
    diff = good[rng.integers(0, len(good), PAIRS)] - bad[rng.integers(0, len(bad), PAIRS)]
    w = newton(lambda w: newton_sums(diff, w), PAIRS, diff.shape[1])
    sg, sb = np.sort(good @ w), np.sort(bad @ w)
    grid = np.quantile(np.concatenate([sg, sb]), np.linspace(0, 1, GRID))
    return Ranker(w, mean, scale, grid, best_cut(np.searchsorted(sg, grid), np.searchsorted(sb, grid), len(sg), len(sb)))


def _rows_of(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _total(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of`` over all feature rows ``x``: one row a task reaches the driver, in task order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                part = of(_rows_of(b.column("x")))
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

    return np.sum([r.s for r in rows.select("x").mapInArrow(run, "s array<double>").collect()], axis=0)


def labelled_features(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """``(quality, doc_id, x)`` of every labelled document that ``allowed`` admits, written once."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & allowed).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tolist() for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("quality"), b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))],
                ["quality", "doc_id", "x"])

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = join_small_side(texts, marked, ["doc_id"], F.xxhash64("text"))
    return stored(rows.select("quality", "doc_id", "text").mapInArrow(run, "quality int, doc_id long, x array<double>"),
                  "quality-features")


def preference_pairs(rows: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, int]:
    """``x``: feature differences of pairs that hold every document, and their number.

    Documents of a label are numbered by a hash; pair n has good n mod G and bad n mod B,
    and each further round over the larger label shifts the smaller one by a place.
    """
    n_good, n_bad = counts[1], counts[0]
    most = max(n_good, n_bad)
    rounds = -(-PAIRS // most) if most < PAIRS else 1
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "x"))
    at = dense_index(keyed, ["quality"], ["key", "doc_id"], out="at").select("quality", "at", "x")
    turns = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    large, small = (1, 0) if n_good >= n_bad else (0, 1)
    big = (at.filter(F.col("quality") == large).select("x", "at", turns.alias("turn"))
           .select(F.col("x").alias("big"), F.pmod(F.col("at") + F.col("turn"), F.lit(min(n_good, n_bad))).alias("at"), "turn"))
    few = at.filter(F.col("quality") == small).select(F.col("x").alias("few"), "at")
    good, bad = ("big", "few") if large == 1 else ("few", "big")
    pairs = join_small_side(big, few, ["at"], F.xxhash64("big")).select(F.zip_with(good, bad, lambda g, b: g - b).alias("x"))
    return stored(pairs, "quality-pairs"), most * rounds


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Ranker | None:
    """Fit on all labelled documents that ``allowed`` (over doc_id) admits; None unless both labels occur."""
    rows = labelled_features(docs, labels, allowed)
    counts = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    if set(counts) != {0, 1}:
        return None
    n = counts[0] + counts[1]
    mean = _total(rows, lambda x: x.sum(0)) / n
    scale = np.sqrt(_total(rows, lambda x: ((x - mean) ** 2).sum(0)) / n)
    scale[scale < 1e-9] = 1.0
    pairs, n_pairs = preference_pairs(rows, counts)
    w = newton(lambda w: _total(pairs, lambda d: newton_sums(d / scale, w)), n_pairs, len(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = ((_rows_of(b.column("x")) - mean) / scale) @ w if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(s, pa.float64())], ["quality", "s"])

    scores = stored(rows.select("quality", "x").mapInArrow(run, "quality int, s double"), "quality-scores")
    # quantiles from the scores at the two ranks around each; the cut from counts below each of them
    place = np.linspace(0, 1, GRID) * (n - 1)
    wanted = sorted({int(p) for p in np.floor(place)} | {int(p) for p in np.ceil(place)})
    ranks = docs.sparkSession.createDataFrame([(k,) for k in wanted], "at long")  # at most 2 * GRID rows
    at = {r["at"]: r.s for r in dense_index(scores.select("s"), [], ["s"], out="at").join(F.broadcast(ranks), "at").collect()}
    low, high = (np.array([at[int(p)] for p in f(place)]) for f in (np.floor, np.ceil))
    grid = low + (high - low) * (place - np.floor(place))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.searchsorted(grid, b.column("s").to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(k, pa.int64())], ["quality", "k"])

    seen = np.zeros((2, GRID + 1))  # scores below grid[j] are those with k <= j
    for r in scores.mapInArrow(below, "quality int, k long").groupBy("quality", "k").count().collect():
        seen[r.quality, r.k] = r["count"]
    upto = seen.cumsum(1)[:, :GRID]
    return Ranker(w, mean, scale, grid, best_cut(upto[1], upto[0], counts[1], counts[0]))


def score_documents(docs: DataFrame, model: Ranker | None) -> DataFrame:
    """``(doc_id, score, predicted)`` from the text alone; THRESHOLD for all without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ranker = shared.value
                s = (np.full(part.num_rows, THRESHOLD) if ranker is None
                     else ranker.score(feature_matrix(as_bytes(part.column("text")))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int")


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``.

    Null texts score as empty ones. A document labelled twice counts with each of
    its labels; labels other than 0 and 1 and rows without doc_id teach nothing.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return (score_documents(docs, train(docs, labels, ~held))
            .select("doc_id", held.alias("held_out"), "score", "predicted"))
