"""Op 1, language ID: a linear-chain conditional random field over the words of each sentence.

Every word gets a label from affix, character n-gram and lexicon features and
learned transitions, so code-switched text is labelled word by word. A document's
language is the one with the largest sum of word marginals (forward-backward).

The model is fitted on the driver from a bounded sample of labelled documents
(``TRAIN_DOCS`` per language, ``TRAIN_SENTENCES`` sentences each, at most
``TRAIN_WORDS`` words a sentence) and broadcast; scoring reads whole texts.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.base import crc_mod, sample_per_group, slices, small_batches

TRAIN_DOCS, TRAIN_SENTENCES, TRAIN_WORDS = 250, 8, 60
MIN_COUNT, ROUNDS, RATE, RIDGE = 3, 60, 0.3, 1e-5
#: Text that is scored in one step.
STEP_BYTES = 1 << 20
UNKNOWN = "und"

#: Letters run together; sentence ends separate chains.
_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
_END = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """Lexicon entry, prefixes, suffixes and inner character n-grams of a lower-case word."""
    n, marked = len(word), f"^{word}$"
    out = ["w" + word]
    out += ["p" + word[:k] for k in (1, 2, 3) if k < n]
    out += ["s" + word[-k:] for k in (1, 2, 3, 4) if k < n]
    out += ["g" + marked[i:i + k] for k in (2, 3) for i in range(len(marked) - k + 1)]
    return out


def chains(text: str) -> list[list[str]]:
    """Sentences of a text as lists of lower-case words."""
    out, now = [], []
    for t in _TOKENS.findall(text.lower()):
        if t in _END:
            if now:
                out.append(now)
                now = []
        else:
            now.append(t)
    return out + [now] if now else out


def forward_backward(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of concatenated chains, all chains advanced together.

    ``emit`` (words x labels) and ``trans`` hold positive potentials, ``lens`` the
    length of each chain. With ``pairs`` also the summed pair marginals.
    """
    order = np.argsort(-lens, kind="stable")
    starts = (np.cumsum(lens) - lens)[order]
    top = int(lens.max())
    active = len(lens) - np.searchsorted(np.sort(lens), np.arange(top), side="right")
    alpha = np.empty_like(emit)
    now = emit[:0]
    for t in range(top):
        at = starts[:active[t]] + t
        now = emit[at] if t == 0 else (now[:active[t]] @ trans) * emit[at]
        now = now / now.sum(1, keepdims=True)
        alpha[at] = now
    both = np.zeros_like(trans)
    post = np.empty_like(emit)
    later = np.empty((0, emit.shape[1]))
    for t in range(top - 1, -1, -1):
        at = starts[:active[t]] + t
        beta = np.ones((active[t], emit.shape[1]))
        if len(later):
            part = later @ trans.T
            if pairs:
                a = alpha[at[:len(later)]]
                scale = (a * part).sum(1, keepdims=True)
                both += ((a / scale).T @ later) * trans
            beta[:len(later)] = part / part.sum(1, keepdims=True)
        p = alpha[at] * beta
        post[at] = p / p.sum(1, keepdims=True)
        later = emit[at] * beta
    return (post, both) if pairs else post


@dataclass
class Crf:
    """Labels, feature index, feature weights and transition weights."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission potentials of words, the largest of each scaled to 1."""
        get, rows, sizes = self.index.get, [], []
        for w in words:
            own = [i for i in map(get, features(w)) if i is not None]
            own.append(0)  # the bias
            rows += own
            sizes.append(len(own))
        starts = np.cumsum([0] + sizes[:-1])
        e = np.add.reduceat(self.weights[rows], starts, axis=0)
        return np.exp(e - e.max(1, keepdims=True))


def fit(rows: list[tuple[str, list[list[str]]]]) -> Crf | None:
    """Maximum-likelihood weights (Adam, ridge) from ``(language, sentences)`` rows.

    Every third sentence is chained to one of another row, so that transitions
    between languages are seen at a natural rate.
    """
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    code = {lang: k for k, lang in enumerate(labels)}
    sents = [(code[lang], s) for lang, ss in rows for s in ss if s]
    if not sents:
        return None
    order = np.random.default_rng(1).permutation(len(sents))
    lens, ids, gold, vocab = [], [], [], {}
    for place, k in enumerate(order):
        y, s = sents[k]
        if place % 3 == 1:
            lens[-1] += len(s)
        else:
            lens.append(len(s))
        ids += [vocab.setdefault(w, len(vocab)) for w in s]
        gold += [y] * len(s)
    lens, ids, gold = np.array(lens), np.array(ids), np.array(gold)
    words = list(vocab)
    seen = np.bincount(ids)
    counts: Counter[str] = Counter()
    feats = [features(w) for w in words]
    for f, c in zip(feats, seen.tolist(), strict=True):
        for x in f:
            counts[x] += c
    index = {f: k for k, f in enumerate((x for x, c in counts.items() if c >= MIN_COUNT), 1)}
    flat, sizes = [], []
    for f in feats:
        own = [index[x] for x in f if x in index] + [0]
        flat += own
        sizes.append(len(own))
    flat, sizes = np.array(flat), np.array(sizes)
    starts = np.cumsum(sizes) - sizes
    n_lab, n_feat, n = len(labels), len(index) + 1, len(ids)
    weights, trans = np.zeros((n_feat, n_lab)), np.zeros((n_lab, n_lab))
    joint = ids * n_lab + gold
    true = np.bincount(joint, minlength=len(words) * n_lab).reshape(-1, n_lab)
    first = np.zeros(n, bool)
    first[np.cumsum(lens) - lens] = True
    follow = np.flatnonzero(~first)
    true_pairs = np.bincount(gold[follow - 1] * n_lab + gold[follow], minlength=n_lab**2).reshape(n_lab, n_lab)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, ROUNDS + 1):
        e = np.add.reduceat(weights[flat], starts, axis=0)
        e = np.exp(e - e.max(1, keepdims=True))
        post, pair = forward_backward(e[ids], lens, np.exp(trans), pairs=True)
        seen_post = np.stack([np.bincount(ids, weights=post[:, k], minlength=len(words)) for k in range(n_lab)], 1)
        gap = np.repeat((true - seen_post) / n, sizes, axis=0)
        g = np.stack([np.bincount(flat, weights=gap[:, k], minlength=n_feat) for k in range(n_lab)], 1)
        for value, grad, m, v in ((weights, g - RIDGE * weights, *moments[:2]),
                                  (trans, (true_pairs - pair) / n - RIDGE * trans, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, index, weights, np.exp(trans))


def train(docs: DataFrame, allowed) -> Crf | None:
    """Fit on a bounded, hash-ordered sample of each language's labelled documents."""
    spark = docs.sparkSession
    labelled = small_batches(docs).select(F.col("doc_id").cast("long"), "lang", "text") \
        .filter(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    picked = sample_per_group(labelled.select("doc_id", "lang"), "lang", TRAIN_DOCS)
    ids = [r.doc_id for r in picked.select("doc_id").distinct().collect()]  # TRAIN_DOCS per language
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id long")

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, kept = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                all_of = chains(text)
                step = max(1, len(all_of) // TRAIN_SENTENCES)
                langs.append(lang)
                kept.append([s[:TRAIN_WORDS] for s in all_of[::step][:TRAIN_SENTENCES]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(kept, pa.list_(pa.list_(pa.string())))], ["lang", "s"])

    sample = (labelled.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")
              .select("lang", "text").mapInArrow(sentences, "lang string, s array<array<string>>"))
    rows = sorted((r.lang, [list(s) for s in r.s]) for r in sample.collect())
    return fit(rows)


class Labeller:
    """Scores documents with a model, keeping potentials of words already met."""

    def __init__(self, model: Crf, limit: int = 150_000):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = dict.fromkeys(_END, -1)
        self.table = np.empty((0, len(self.model.labels)))

    def _learn(self, words: set[str]) -> None:
        """Potentials of the words not met yet; starts anew when too many are kept."""
        new = sorted(words - self.known.keys())
        if len(self.known) + len(new) > self.limit:
            self._forget()
            new = sorted(words - _END)
        if new:
            rows = self.model.scores(new)
            rows[[not any(map(str.isalpha, w)) for w in new]] = 1  # other word characters say nothing
            first = len(self.table)
            self.known |= zip(new, range(first, first + len(new)))
            self.table = np.concatenate([self.table, rows])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """``(language, share, words, switches)`` of each text."""
        docs = [_TOKENS.findall(t.lower()) if t else [] for t in texts]
        need = set()
        for d in docs:
            need.update(d)
        self._learn(need)
        code = map(self.known.__getitem__, itertools.chain.from_iterable(docs))
        flat = np.fromiter(code, np.int64, sum(map(len, docs)))
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        word = flat >= 0
        # a chain starts at a document's first word and after every sentence end
        starts = np.ones(len(flat), bool)
        starts[1:] = (owner[1:] != owner[:-1]) | ~word[:-1]
        chain = (np.cumsum(starts) - 1)[word]
        out: list[tuple[str, float, int, int]] = [(UNKNOWN, 0.0, 0, 0)] * len(docs)
        if not len(chain):
            return out
        lens = np.bincount(chain)
        lens = lens[lens > 0]
        post = forward_backward(self.table[flat[word]], lens, self.model.trans)
        own, n_lab = owner[word], len(self.model.labels)
        total = np.stack([np.bincount(own, weights=post[:, k], minlength=len(docs)) for k in range(n_lab)], 1)
        counts = np.bincount(own, minlength=len(docs))
        best = post.argmax(1)
        moved = (best[1:] != best[:-1]) & (chain[1:] == chain[:-1])
        switches = np.bincount(own[1:][moved], minlength=len(docs))
        pick = total.argmax(1)
        for i in np.flatnonzero(counts).tolist():
            if any(map(str.isalpha, texts[i])):
                share = float(total[i, pick[i]] / counts[i])
                out[i] = (self.model.labels[pick[i]], min(1.0, share), int(counts[i]), int(switches[i]))
        return out


def label_languages(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Add ``lang_pred, score, n_words, switches`` to ``docs`` from the text alone.

    Text that is null or has no letter, and any text without a model, is ``und``
    with score 0. Rows are independent: ties and repeats change nothing, and a
    tied document takes the first language by name.
    """
    docs = small_batches(docs.drop("lang_pred", "score", "n_words", "switches"))
    fields = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()),
                        ("switches", pa.int64())])
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("switches"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        label = Labeller(shared.value)
        for texts in batches:
            rows = []
            for at, n in slices(texts, STEP_BYTES):
                rows += label(texts.slice(at, n).to_pylist())
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)],
                                             fields=list(fields))

    # only texts go to Python and only labels come back; once, as the result counts as not repeatable
    found = F.arrow_udf(run, "lang_pred string, score double, n_words long, switches long").asNondeterministic()
    tag = f"_labels_{uuid.uuid4().hex[:8]}"
    return docs.withColumn(tag, found(F.col("text"))).select(*[docs[c] for c in docs.columns], f"{tag}.*")


def detect(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score`` (and words, switches), learnt from the rest."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, ~held)
    return (label_languages(docs.select("doc_id", "text"), model)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "switches"))
