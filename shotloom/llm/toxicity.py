"""Op 12, toxicity: a convolutional text classifier in numpy, with a threshold for each language.

A word's vector is the sum of hashed embeddings: the word itself, its beginnings and
its end. Filters of several widths slide over the words of a text, the largest value
of each filter (max pooling) is kept, and a logistic unit scores the pooled values.
Embeddings, filters and unit are trained together by Adam on the logistic loss.

The language of a text is guessed from the same words (naive Bayes over whole words,
learnt from labelled languages), and each language has its own cut, calibrated on
documents that the training held back and laid on ``THRESHOLD``.

Training starts on the driver from a bounded, hash-ordered sample (``TRAIN_DOCS`` of
each label). Where that is not every whole labelled text, Spark goes on over all of
them: the buckets, the language odds and the cuts are counts of all labelled
documents, and in each of ``ROUNDS`` every task trains on its own documents and the
changes are averaged, those of a bucket over the tasks that met it. Training and
scoring read whole texts, in steps of bounded size also within one long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import crc_mod, join_small_side, mix64, slices, small_batches, stored, top_k

THRESHOLD = 0.3
TRAIN_DOCS, TRAIN_BYTES, MIN_COUNT = 1500, 100_000, 3
BUCKETS, WIDTH, WIDTHS, FILTERS = 1 << 18, 16, (1, 2, 3), 16
#: Passes over all labelled documents; bytes of their texts in a task; fixed point of summed changes; steps of a cut.
ROUNDS, PART_BYTES, FIXED, CUT_STEPS = 2, 8 << 20, 1 << 20, 256
#: Passes over the sample, more of them where it is small; share of words hidden from a pass; size of first embeddings.
EPOCHS, UPDATES, BATCH, RATE, RIDGE, FORGET, INIT = 5, 300, 64, 0.01, 3e-3, 0.1, 0.01
#: Documents of each label that calibrate a cut of their own; each fifth one is held back for it.
CALIBRATE, BACK = 25, 5
STEP_BYTES, STEP_WORDS, KNOWN_WORDS = 1 << 19, 1 << 15, 250_000
PREFIXES = (4, 5, 6)
PARTS = 1 + len(PREFIXES)
_PADS = max(WIDTHS) - 1
#: Anything of ASCII but letters separates words.
_SPLIT = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalpha()), b" " * (128 - 52))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPLIT).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """Buckets of each whole word and of its first 4, 5 and 6 bytes (words x 4)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), PARTS), np.uint64)
    if not len(words):
        return out.astype(np.int64)
    start = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    terms = (np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)) * power[at]
    for k, most in enumerate((None, *PREFIXES)):
        part = np.add.reduceat(terms if most is None else np.where(at < most, terms, 0), start)
        out[:, k] = mix64(part + np.uint64(k))
    return (out % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Cnn:
    """The trained buckets (in order), their embeddings and language log-odds, filters, output unit and cuts.

    The k-th bucket has row k + 1. Row 0 is all zeros: untrained buckets and the places between texts.
    """

    buckets: np.ndarray
    embed: np.ndarray
    odds: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, WIDTH, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    cuts: np.ndarray

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Embedding and language log-odds of each word."""
        rows = rows_of(hashed(words), self.buckets)
        return np.concatenate([self.embed[rows].sum(1), self.odds[rows[:, 0]]], axis=1)


def rows_of(parts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Row of each bucket, 0 where it was not trained."""
    if not len(buckets):
        return np.zeros_like(parts)
    k = np.minimum(np.searchsorted(buckets, parts), len(buckets) - 1)
    return np.where(buckets[k] == parts, k + 1, 0)


def convolved(x: np.ndarray, filters: dict[int, np.ndarray], bias: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Filter values of every window that starts at a word, for each width; short windows at the end end in zeros."""
    n, out = len(x), []
    for w, f in filters.items():
        y = np.repeat(bias[w][None], n, axis=0)
        for j in range(min(w, n)):
            y[:n - j] += x[j:] @ f[j]
        out.append(np.maximum(y, 0, out=y))
    return out


def pool(ids: np.ndarray, lens: np.ndarray, table: np.ndarray, model: Cnn) -> tuple[np.ndarray, np.ndarray]:
    """Largest filter values and summed language log-odds of each text.

    ``ids`` holds each text's words, then ``_PADS`` places of row 0, and ``table`` the
    vectors of the rows. Texts are taken ``STEP_WORDS`` words at a time and a text's
    steps are merged, so memory does not grow with the longest text.
    """
    ends = np.cumsum(lens + _PADS)
    begin = ends - lens - _PADS
    pooled = np.zeros((len(lens), FILTERS * len(WIDTHS)), np.float32)
    sums = np.zeros((len(lens), table.shape[1] - WIDTH))
    blank = np.zeros(len(ids), bool)
    for k in range(_PADS):
        blank[ends - 1 - k] = True
    for a in range(0, len(ids), STEP_WORDS):
        b = min(len(ids), a + STEP_WORDS)
        x = table[ids[a:min(len(ids), b + _PADS)]]
        y = np.concatenate([v[:b - a] for v in convolved(x[:, :WIDTH], model.filters, model.bias)], axis=1)
        y[blank[a:b]] = 0
        first = int(np.searchsorted(ends, a, side="right"))
        last = int(np.searchsorted(begin, b, side="left"))
        starts = np.maximum(begin[first:last] - a, 0)
        pooled[first:last] = np.maximum(pooled[first:last], np.maximum.reduceat(y, starts, axis=0))
        sums[first:last] += np.add.reduceat(x[:b - a, WIDTH:], starts, axis=0)
    return pooled, sums


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.zeros(_PADS, np.int64)
    return np.concatenate([p for d in docs for p in (d, gap)] or [gap[:0]]), np.array([len(d) for d in docs], np.int64)


class Adam:
    """Adam steps on an array, or on some of its rows with their own moments."""

    def __init__(self, value: np.ndarray):
        self.value, self.m, self.v, self.t = value, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        m = self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        v = self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        self.value[rows] -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def peaks(x: np.ndarray, lens: np.ndarray, model: Cnn) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width the place and value of each filter's largest window in each text, ``STEP_WORDS`` places at a time."""
    ends = np.cumsum(lens + _PADS)
    begin = ends - lens - _PADS
    at = [np.repeat(begin[:, None], FILTERS, axis=1) for _ in WIDTHS]
    top = [np.zeros((len(lens), FILTERS)) for _ in WIDTHS]
    cols = np.arange(FILTERS)
    for a in range(0, len(x), STEP_WORDS):
        b = min(len(x), a + STEP_WORDS)
        values = convolved(x[a:min(len(x), b + _PADS)], model.filters, model.bias)
        for d in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(begin, b, side="left"))):
            low, high = max(int(begin[d]), a) - a, min(int(begin[d] + lens[d]), b) - a
            if low >= high:
                continue
            for k, v in enumerate(values):
                best = v[low:high].argmax(0)
                value = v[low + best, cols]
                more = value > top[k][d]
                top[k][d][more] = value[more]
                at[k][d][more] = (a + low + best)[more]
    return at, top


def gradients(x: np.ndarray, lens: np.ndarray, y: np.ndarray, model: Cnn,
              weight: np.ndarray | float = 1.0) -> tuple[float, dict, np.ndarray, np.ndarray]:
    """Mean logistic loss, gradients of filters and unit, and those of the word vectors (places, rows)."""
    at, top = peaks(x, lens, model)
    pooled = np.concatenate(top, axis=1)
    z = np.clip(pooled @ model.out + model.out_bias, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    dz = weight * (p - y) / len(y)
    grads = {"out": pooled.T @ dz, "out_bias": np.array([dz.sum()])}
    places, rows = [], []
    for k, w in enumerate(WIDTHS):
        up = dz[:, None] * model.out[k * FILTERS:(k + 1) * FILTERS] * (top[k] > 0)
        grads["bias", w] = up.sum(0)
        grads["filters", w] = np.empty_like(model.filters[w])
        for j in range(w):
            # a window over the end of all texts reads zeros there
            inside = np.minimum(at[k] + j, len(x) - 1)
            here = up * (at[k] + j < len(x))
            grads["filters", w][j] = np.einsum("bf,bfd->df", here, x[inside])
            places.append(inside.ravel())
            rows.append((here[..., None] * model.filters[w][j].T).reshape(-1, x.shape[1]))
    return loss, grads, np.concatenate(places), np.concatenate(rows)


def guess(sums: np.ndarray) -> np.ndarray:
    """Language number of each text from its summed log-odds (ties: the first by name)."""
    return sums.argmax(1) if sums.shape[1] else np.zeros(len(sums), np.int64)


def cut_between(good: np.ndarray, bad: np.ndarray, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """The value that best parts ``bad`` (label 1, above) from ``good``, in the middle of its gap.

    ``n_good`` and ``n_bad`` say how often each value was met (once, if not given).
    """
    def below(values: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        order = np.argsort(values)
        upto = np.concatenate([[0], np.cumsum(np.ones(len(values)) if n is None else n[order])])
        return upto[np.searchsorted(values[order], mids)] / upto[-1]

    both = np.unique(np.concatenate([good, bad]))
    mids = np.concatenate([both[:1] - 1, (both[1:] + both[:-1]) / 2, both[-1:] + 1])
    gain = 1 - below(bad, n_bad) + below(good, n_good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # of equally good cuts the one with the widest gap
    width = np.diff(np.concatenate([both[:1] - 1, both, both[-1:] + 1]))
    return float(mids[best[width[best].argmax()]])


def fit(texts: list[str], labels: list[int], langs: list[str | None]) -> Cnn | None:
    """Train on labelled texts (0 or 1); None unless both labels occur."""
    y = np.array(labels, float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    rng = np.random.default_rng(12)
    docs = [words_of(t) for t in texts]
    vocab = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    parts = hashed(list(vocab))
    ids = [np.fromiter((vocab[w] for w in d), np.int64, len(d)) for d in docs]
    met = np.concatenate([np.unique(parts[np.unique(d)]) for d in ids])
    buckets, seen = np.unique(met, return_counts=True)  # documents that hold the bucket
    buckets = buckets[seen >= MIN_COUNT]
    parts = np.concatenate([np.zeros((1, PARTS), np.int64), rows_of(parts, buckets)])
    ids = [d + 1 for d in ids]  # word 0 has no rows

    embed = rng.normal(0, INIT, (len(buckets) + 1, WIDTH))
    embed[0] = 0
    model = Cnn(buckets, embed, _language_odds(ids, langs, parts[:, 0], len(embed)),
                {w: rng.normal(0, 1 / np.sqrt(WIDTH * w), (w, WIDTH, FILTERS)) for w in WIDTHS},
                {w: np.zeros(FILTERS) for w in WIDTHS}, rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0,
                sorted({x for x in langs if x is not None}), np.zeros(1))
    order = rng.permutation(len(y))
    enough = min(y.sum(), len(y) - y.sum()) >= 2 * BACK * CALIBRATE
    back = order[::BACK] if enough else order
    learn = np.setdiff1d(order, back) if enough else order

    bias = np.zeros(1)
    params = {("filters", w): Adam(f) for w, f in model.filters.items()}
    params |= {("bias", w): Adam(b) for w, b in model.bias.items()} | {"out": Adam(model.out), "out_bias": Adam(bias)}
    deep = Adam(embed)
    batches = max(1, len(learn) // BATCH)
    for _ in range(max(EPOCHS, -(-UPDATES // batches))):
        for group in np.array_split(rng.permutation(learn), batches):
            flat, lens = padded([ids[d] for d in group])
            flat = np.where(rng.random(len(flat)) < FORGET, 0, flat)
            used, back_to = np.unique(flat, return_inverse=True)
            x = embed[parts[used]].sum(1)[back_to]
            _, grads, places, up = gradients(x, lens, y[group], model)
            for name, g in grads.items():
                params[name].step(g + RIDGE * params[name].value)
            touched, where = np.unique(parts[flat[places]], return_inverse=True)
            total = np.zeros((len(touched), WIDTH))
            np.add.at(total, where.reshape(-1), np.repeat(up, PARTS, axis=0))
            real = touched > 0
            deep.step((total + RIDGE * embed[touched])[real], touched[real])
            model.out_bias = float(bias[0])
    model.embed = embed.astype(np.float32)
    model.filters = {w: f.astype(np.float32) for w, f in model.filters.items()}
    model.bias = {w: b.astype(np.float32) for w, b in model.bias.items()}
    _calibrate(model, [docs[d] for d in back], y[back])
    return model


class Learner:
    """Adam over batches of documents, from a given model; what it changed, for averaging."""

    def __init__(self, model: Cnn, weights: np.ndarray):
        self.model, self.weights = model, weights
        self.rows: dict[bytes, int] = {}
        self.parts = np.zeros((1, PARTS), np.int64)
        self.bias = np.array([model.out_bias])
        self.dense = {("filters", w): Adam(f.astype(float)) for w, f in model.filters.items()}
        self.dense |= {("bias", w): Adam(b.astype(float)) for w, b in model.bias.items()}
        self.dense |= {"out": Adam(model.out.astype(float)), "out_bias": Adam(self.bias)}
        self.deep = Adam(model.embed.astype(np.float32))
        self.met = np.zeros(len(model.embed), np.int64)
        self.steps = 0
        self.rng = np.random.default_rng(12)
        self.now = Cnn(model.buckets, self.deep.value, model.odds, {w: self.dense["filters", w].value for w in WIDTHS},
                       {w: self.dense["bias", w].value for w in WIDTHS}, self.dense["out"].value, model.out_bias, [], model.cuts)

    def _learn(self, docs: list[list[bytes]]) -> None:
        need = set().union(*docs)
        new = need - self.rows.keys()
        if len(self.rows) + len(new) > KNOWN_WORDS:
            self.rows, self.parts, new = {}, np.zeros((1, PARTS), np.int64), need
        if new:
            order = list(new)
            self.rows.update(zip(order, range(len(self.parts), len(self.parts) + len(order)), strict=True))
            self.parts = np.concatenate([self.parts, rows_of(hashed(order), self.model.buckets)])

    def step(self, docs: list[list[bytes]], y: np.ndarray) -> None:
        self._learn(docs)
        texts = [self.parts[np.fromiter(map(self.rows.__getitem__, d), np.int64, len(d))] for d in docs]
        gap = np.zeros((_PADS, PARTS), np.int64)
        flat = np.concatenate([p for t in texts for p in (t, gap)])
        flat[self.rng.random(len(flat)) < FORGET] = 0
        lens = np.array([len(t) for t in texts], np.int64)
        embed = self.deep.value
        x = sum(embed[flat[:, k]] for k in range(PARTS))
        self.now.out_bias = float(self.bias[0])
        _, grads, places, up = gradients(x, lens, y, self.now, self.weights[y.astype(int)])
        for name, g in grads.items():
            self.dense[name].step(g + RIDGE * self.dense[name].value)
        touched, where = np.unique(flat[places], return_inverse=True)
        total = np.zeros((len(touched), WIDTH))
        np.add.at(total, where.reshape(-1), np.repeat(up, PARTS, axis=0))
        real = touched > 0
        self.deep.step((total + RIDGE * embed[touched])[real], touched[real])
        self.met[touched[real]] += 1
        self.steps += 1

    def changes(self) -> pa.RecordBatch:
        """``(row, n, d0, ...)``: times met and as many times the change, in fixed point; rows under 0 hold what is dense."""
        rows = np.flatnonzero(self.met)
        n = self.met[rows]
        deep = (self.deep.value[rows] - self.model.embed[rows]) * n[:, None]
        flat = (_dense(self.now, float(self.bias[0])) - _dense(self.model, self.model.out_bias)) * self.steps
        values = np.rint(np.concatenate([deep, flat]) * FIXED).astype(np.int64)
        rows = np.concatenate([rows, -1 - np.arange(len(flat))])
        n = np.concatenate([n, np.full(len(flat), self.steps)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (rows, n, *values.T)], ["row", "n", *_CHANGES])


_CHANGES = [f"d{i}" for i in range(WIDTH)]


def _dense(model: Cnn, bias: float) -> np.ndarray:
    """Filters, biases and unit as rows of WIDTH values."""
    flat = np.concatenate([*(model.filters[w].ravel() for w in WIDTHS), *(model.bias[w] for w in WIDTHS), model.out, [bias]]).astype(float)
    return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)


def _changed(model: Cnn, rows: np.ndarray, change: np.ndarray) -> Cnn:
    embed = model.embed.copy()
    embed[rows[rows > 0]] += change[rows > 0].astype(np.float32)
    dense = _dense(model, model.out_bias)
    dense[-1 - rows[rows < 0]] += change[rows < 0]
    flat, filters, biases = dense.ravel(), {}, {}
    for w in WIDTHS:
        filters[w], flat = flat[:w * WIDTH * FILTERS].reshape(w, WIDTH, FILTERS).astype(np.float32), flat[w * WIDTH * FILTERS:]
    for w in WIDTHS:
        biases[w], flat = flat[:FILTERS].astype(np.float32), flat[FILTERS:]
    n = FILTERS * len(WIDTHS)
    return Cnn(model.buckets, embed, model.odds, filters, biases, flat[:n].copy(), float(flat[n]), model.languages, model.cuts)


def _language_odds(ids: list[np.ndarray], langs: list[str | None], row: np.ndarray, n_rows: int) -> np.ndarray:
    """Log-odds of every row's words for each language, from the documents whose language is known."""
    names = sorted({x for x in langs if x is not None})
    count = np.zeros((n_rows, len(names)))
    for d, lang in zip(ids, langs, strict=True):
        if lang is not None:
            np.add.at(count[:, names.index(lang)], row[d], 1)
    count[0] = 0
    return _odds(count)


def _odds(count: np.ndarray) -> np.ndarray:
    """Log-odds of each language for every row, from the words counted there (rows x languages)."""
    n_rows, names = count.shape
    share = np.log((count + 0.5) / (count.sum(0) + 0.5 * n_rows))
    odds = share - share.mean(1, keepdims=True) if names else share
    odds[0] = 0
    return odds.astype(np.float32)


def _calibrate(model: Cnn, docs: list[list[bytes]], y: np.ndarray) -> None:
    """One cut for each language with enough documents of both labels, the common cut for the others."""
    z, lang = Scorer(model).raw(docs)
    common = cut_between(z[y == 0], z[y == 1])
    model.cuts = np.full(max(1, len(model.languages)), common)
    for k in range(len(model.cuts)):
        good, bad = z[(y == 0) & (lang == k)], z[(y == 1) & (lang == k)]
        if min(len(good), len(bad)) >= CALIBRATE:
            model.cuts[k] = cut_between(good, bad)


class Scorer:
    """Scores texts, keeping the vectors of words already met (at most ``limit`` and one step's)."""

    def __init__(self, model: Cnn, limit: int = KNOWN_WORDS):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1, WIDTH + len(self.model.languages)), np.float32)

    def _learn(self, docs: list[list[bytes]]) -> None:
        need = set().union(*docs)
        new = need - self.known.keys()
        if len(self.known) + len(new) > self.limit:
            self._forget()
            new = need
        if new:
            order = list(new)
            self.known.update(zip(order, range(len(self.table), len(self.table) + len(order)), strict=True))
            self.table = np.concatenate([self.table, self.model.vectors(order).astype(np.float32)])

    def raw(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Output of the unit before calibration, and the guessed language number, of each text."""
        self._learn(docs)
        get = self.known.__getitem__
        ids, lens = padded([np.fromiter(map(get, d), np.int64, len(d)) for d in docs])
        if not len(docs):
            return np.zeros(0), np.zeros(0, np.int64)
        pooled, sums = pool(ids, lens, self.table, self.model)
        return pooled.astype(np.float64) @ self.model.out + self.model.out_bias, guess(sums)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores in 0 to 1, the cut of the guessed language laid on THRESHOLD, and that language's number."""
        z, lang = self.raw([words_of(t) for t in texts])
        over = z - self.model.cuts[lang]
        s = 1 / (1 + np.exp(-np.clip(over + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
        return np.where(over >= 0, np.maximum(s, THRESHOLD), np.minimum(s, np.nextafter(THRESHOLD, 0))), lang


def _marked(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[DataFrame, DataFrame]:
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed).distinct())
    return marked, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("text is not null")


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, keep: Column | None = None) -> list[tuple[str, int, str | None]]:
    """``(text, label, lang)`` of at most TRAIN_DOCS distinct labelled texts of each label.

    Texts are picked by a hash of id and text, and only the lowest part of the hash
    space that should hold 1.5 times as many is ranked. Of repeated rows one is taken,
    so neither the ranking nor the driver's rows grow with the input. Only texts that
    ``keep`` (over digest) admits are taken.
    """
    marked, texts = _marked(docs, labels, allowed)
    digest = F.xxhash64("doc_id", "text").alias("digest")
    keys = join_small_side(texts.select("doc_id", digest), marked, ["doc_id"], F.col("digest")).distinct()
    keys = keys if keep is None else keys.filter(keep)
    counts = {r.toxic: r["count"] for r in keys.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return []
    u = F.pmod(F.col("digest"), F.lit(1 << 32)).cast("double") / (1 << 32)
    size = F.when(F.col("toxic") == 1, F.lit(counts[1])).otherwise(F.lit(counts[0]))
    low = keys.filter(u * size <= 1.5 * TRAIN_DOCS + 10)
    picked = top_k(low, ["toxic"], [u, F.col("digest"), F.col("doc_id")], TRAIN_DOCS).select("doc_id", "digest", "toxic")
    rows = texts.withColumn("digest", digest).join(F.broadcast(picked), ["doc_id", "digest"])  # 2 * TRAIN_DOCS keys
    once = top_k(rows, ["doc_id", "digest", "toxic"], [F.col("lang")], 1)
    got = once.select("toxic", "lang", F.substring("text", 1, TRAIN_BYTES).alias("text")).collect()
    return sorted(((r.text, r.toxic, r.lang) for r in got), key=lambda r: (r[1], r[0], r[2] or ""))


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """``(doc_id, digest, toxic, lang, text, task)`` of every whole labelled text, repeated rows once, written once.

    Rows are dealt by digest into tasks of about PART_BYTES of text, a file each in the order of their digests.
    """
    marked, texts = _marked(docs, labels, allowed)
    rows = join_small_side(texts.withColumn("digest", F.xxhash64("doc_id", "text")), marked, ["doc_id"], F.col("digest"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    once = (rows.repartition(max(1, -(-size // PART_BYTES)), "digest").groupBy("doc_id", "digest", "toxic")
            .agg(F.min("lang").alias("lang"), F.first("text").alias("text")))
    return stored(once.withColumn("task", F.spark_partition_id()).sortWithinPartitions("digest", "doc_id", "toxic"), "toxic-texts")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[bytes]], pa.RecordBatch]]:
    """Runs of at most BATCH rows and about STEP_BYTES of text, their texts as words."""
    for b in batches:
        for at, n in slices(b.column("text"), STEP_BYTES):
            for lo in range(at, at + n, BATCH):
                part = b.slice(lo, min(BATCH, at + n - lo))
                yield [words_of(t) for t in part.column("text").to_pylist()], part


def count_words(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that at least MIN_COUNT of all documents hold, and their whole words in each language."""
    width = 1 + len(languages)
    at = {x: k + 1 for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BUCKETS, width), np.int64)
        for docs, part in _steps(batches):
            for words, lang in zip(docs, part.column("lang").to_pylist(), strict=True):
                known = {w: k for k, w in enumerate(dict.fromkeys(words))}
                parts = hashed(list(known))
                seen[np.unique(parts), 0] += 1
                if lang is not None:
                    times = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=len(known))
                    np.add.at(seen[:, at[lang]], parts[:, 0], times)
        bucket, k = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(k), pa.array(seen[bucket, k])], ["bucket", "k", "n"])

    total = rows.select("text", "lang").mapInArrow(run, "bucket long, k long, n long").groupBy("bucket", "k").agg(F.sum("n").alias("n"))
    bucket, k, n = _columns(total)
    seen = np.zeros((BUCKETS, width), np.int64)
    seen[bucket, k] = n
    kept = np.flatnonzero(seen[:, 0] >= MIN_COUNT)
    return kept, seen[kept, 1:]


def _columns(df: DataFrame) -> list[np.ndarray]:
    got = df.toArrow()
    return [got.column(c).to_numpy() for c in got.column_names]


def refine(model: Cnn, rows: DataFrame, counts: dict[int, int]) -> Cnn:
    """One round: every task trains on its documents, in the order of their digests; the mean of the changes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    n = counts[0] + counts[1]
    weights = np.array([n / (2 * counts[0]), n / (2 * counts[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, now, docs, y, size = None, None, [], [], 0
        for b in batches:
            for task, toxic, text in zip(*(b.column(c) for c in ("task", "toxic", "text")), strict=True):
                words = words_of(text.as_py())
                if docs and (task.as_py() != now or len(docs) == BATCH or size + len(words) > STEP_WORDS):
                    learner.step(docs, np.array(y, float))
                    docs, y, size = [], [], 0
                if task.as_py() != now:
                    if learner:
                        yield learner.changes()
                    learner, now = Learner(shared.value, weights), task.as_py()
                docs.append(words)
                y.append(toxic.as_py())
                size += len(words)
        if docs:
            learner.step(docs, np.array(y, float))
            yield learner.changes()

    dealt = rows.select("task", "toxic", "text")
    sums = (dealt.mapInArrow(run, "row long, n long, " + ", ".join(f"{c} long" for c in _CHANGES))
            .groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _CHANGES]))
    row, times, *change = _columns(sums)
    return _changed(model, row, np.stack(change, axis=1) / (FIXED * times[:, None]))


def calibrate(model: Cnn, rows: DataFrame) -> np.ndarray:
    """The cuts of ``model`` from the raw scores of all ``rows``, counted in steps of 1 / CUT_STEPS."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for docs, part in _steps(batches):
            z, lang = score.raw(docs)
            step = np.floor(np.clip(z * CUT_STEPS, -(1 << 20), 1 << 20)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(lang), pa.array(step)], ["toxic", "lang", "step"])

    seen = rows.select("toxic", "text").mapInArrow(run, "toxic int, lang long, step long").groupBy("toxic", "lang", "step").count()
    toxic, lang, step, n = _columns(seen)
    z = (step + 0.5) / CUT_STEPS

    def cut(own: np.ndarray, least: int) -> float | None:
        good, bad = own & (toxic == 0), own & (toxic == 1)
        return cut_between(z[good], z[bad], n[good], n[bad]) if min(n[good].sum(), n[bad].sum()) >= least else None

    common = cut(np.ones(len(z), bool), 1)
    own = [cut(lang == k, CALIBRATE) for k in range(max(1, len(model.languages)))]
    return np.array([model.cuts[0] if common is None else common if c is None else c for c in own])


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Cnn | None:
    """Fit on all labelled documents that ``allowed`` (over doc_id) admits, whole; None unless both labels occur."""
    rows = labelled(small_batches(docs, 256), labels, allowed)
    size = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).collect()}
    if set(size) != {0, 1}:
        return None
    counts = {y: r.n for y, r in size.items()}
    whole = all(r.n <= TRAIN_DOCS and r.longest <= TRAIN_BYTES for r in size.values())
    enough = min(counts.values()) >= 2 * BACK * CALIBRATE
    held = F.pmod(F.xxhash64("digest"), F.lit(BACK)) == 0
    first = sample(docs, labels, allowed, ~held if enough and not whole else None)
    model = fit([r[0] for r in first], [r[1] for r in first], [r[2] for r in first])
    if whole or model is None:
        return model
    languages = sorted(r.lang for r in rows.filter("lang is not null").select("lang").distinct().collect())
    buckets, words = count_words(rows, languages)
    embed = np.random.default_rng(12).normal(0, INIT, (len(buckets) + 1, WIDTH)).astype(np.float32)
    old = np.concatenate([[0], rows_of(buckets, model.buckets)])
    embed[old > 0] = model.embed[old[old > 0]]
    embed[0] = 0
    model.buckets, model.embed, model.languages = buckets, embed, languages
    model.odds, model.cuts = _odds(np.concatenate([np.zeros((1, len(languages)), np.int64), words])), model.cuts[:1]
    learn, back = (rows.filter(~held), rows.filter(held)) if enough else (rows, rows)
    for _ in range(ROUNDS):
        model = refine(model, learn, counts)
    model.cuts = calibrate(model, back)
    return model


def score_texts(docs: DataFrame, model: Cnn | None) -> DataFrame:
    """``(doc_id, score, predicted, lang_guess)`` from the text alone; score 0 for all without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None if shared.value is None else Scorer(shared.value)
        for b in batches:
            texts = b.column("text")
            for at, n in slices(texts, STEP_BYTES):
                if score is None:
                    s, names = np.zeros(n), [None] * n
                else:
                    s, lang = score(texts.slice(at, n).to_pylist())
                    names = [score.model.languages[k] if score.model.languages else None for k in lang.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, n), pa.array(s, pa.float64()),
                     pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(names, pa.string())],
                    ["doc_id", "score", "predicted", "lang_guess"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int, lang_guess string")


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted`` (and ``lang_guess``), learnt from the rest.

    A null text scores as an empty one: no filter fires. Rows are independent, so ties,
    repeated ids and repeated rows keep their own score; a long text is read whole, in
    steps. Labels other than 0 and 1 and rows without doc_id teach nothing; a document
    labelled both ways teaches both. Columns other than doc_id, text, lang and toxic
    are ignored, and an empty table gives none.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, labels, ~held)
    return (score_texts(docs, model)
            .select("doc_id", held.alias("held_out"), "score", "predicted", "lang_guess"))
