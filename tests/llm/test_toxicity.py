import numpy as np
import pytest

from shotloom.llm import toxicity as T
from shotloom.llm.toxicity import Scorer, cut_between, fit, gradients, hashed, judge_toxicity, padded, pool, sample, words_of
from pyspark.sql import functions as F

from llm_cases import DOCS, clashing, hard_docs

LABELS = "doc_id long, quality int, toxic int"


def made(n, seed=0):
    """Texts in two made languages; toxic ones hold a word with a bad stem of their language."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        vocab = [f"{'ta ke no ri su'.split()[k % 5]}{k}" if lang == "aa" else f"ø{'lim gor vel'.split()[k % 3]}{k}"
                 for k in range(60)]
        words = rng.choice(["".join(c for c in w if not c.isdigit()) + "xyzuvw"[j % 6] for j, w in enumerate(vocab)], 30).tolist()
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(30))] = ("grumpf" if lang == "aa" else "zlurk") + "aeiou"[i % 5]
        out.append((i, " ".join(words), lang, int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = made(400)
    return fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])


def plain_score(model, text):
    """Every window of every width by loops, one text at a time."""
    x = [v[:T.WIDTH].astype(float) for v in model.vectors(words_of(text))] if words_of(text) else []
    pooled = []
    for w in T.WIDTHS:
        best = np.zeros(T.FILTERS)
        for i in range(len(x)):
            y = model.bias[w].astype(float)
            for j in range(w):
                if i + j < len(x):
                    y = y + x[i + j] @ model.filters[w][j]
            best = np.maximum(best, y)
        pooled += best.tolist()
    sums = sum((v[T.WIDTH:].astype(float) for v in model.vectors(words_of(text))), np.zeros(len(model.languages)))
    z = np.array(pooled) @ model.out + model.out_bias
    cut = model.cuts[int(sums.argmax())]
    return 1 / (1 + np.exp(-(z - cut + np.log(0.3 / 0.7)))), model.languages[int(sums.argmax())]


def test_scores_match_plain_loops(model, monkeypatch):
    texts = [r[1] for r in made(20, 5)] + [None, "", "one", "grumpfa", "!!", " ".join(made(60, 9)[k][1] for k in range(60))]
    want = [plain_score(model, t) for t in texts]
    for step in (1 << 15, 7):  # texts cut into steps of seven words give the same
        monkeypatch.setattr(T, "STEP_WORDS", step)
        got, lang = Scorer(model)(texts)
        assert np.allclose(got, [s for s, _ in want], atol=1e-4)
        assert [model.languages[k] for k in lang][:20] == [n for _, n in want][:20]
    small = Scorer(model, limit=5)  # forgets known words all the time
    assert np.allclose([small([t])[0][0] for t in texts], got)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    rows = made(40, 2)
    model = fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    model.filters = {w: rng.normal(0, 1, f.shape) for w, f in model.filters.items()}
    model.bias = {w: rng.normal(0, 1, b.shape) for w, b in model.bias.items()}
    model.out = rng.normal(0, 0.05, model.out.shape)
    _, lens = padded([np.arange(5), np.arange(3), np.arange(0)])
    x = rng.normal(0, 1, (int(lens.sum()) + 2 * len(lens), T.WIDTH))
    y = np.array([1.0, 0.0, 1.0])
    _, grads, places, up = gradients(x, lens, y, model)
    deep = np.zeros_like(x)
    np.add.at(deep, places, up)

    def slope(value, at):
        old, eps = value[at], 1e-5
        value[at] = old + eps
        high = gradients(x, lens, y, model)[0]
        value[at] = old - eps
        low = gradients(x, lens, y, model)[0]
        value[at] = old
        return (high - low) / (2 * eps)

    for w in T.WIDTHS:
        assert np.isclose(grads["filters", w][w - 1, 3, 2], slope(model.filters[w], (w - 1, 3, 2)), atol=1e-6)
        assert np.isclose(grads["bias", w][1], slope(model.bias[w], 1), atol=1e-6)
    assert np.isclose(grads["out"][5], slope(model.out, 5), atol=1e-6)
    for at in ((0, 0), (2, 7), (8, 3)):
        assert np.isclose(deep[at], slope(x, at), atol=1e-6)


def test_hashes_read_the_whole_word():
    a, b, c = hashed([b"abcdefgh", b"abcdefgx", b"abc"]).tolist()
    assert a[0] != b[0] and a[1:] == b[1:] and len(set(a)) == 4 and c[0] != a[0]
    assert hashed([b"x" * 50_000 + b"a"])[0, 0] != hashed([b"x" * 50_000 + b"b"])[0, 0]
    assert hashed([]).shape == (0, T.PARTS)


def test_pool_of_no_words(model):
    ids, lens = padded([np.zeros(0, np.int64)] * 3)
    pooled, sums = pool(ids, lens, np.zeros((1, T.WIDTH + 2), np.float32), model)
    assert not pooled.any() and sums.shape == (3, 2)


def test_cuts_are_calibrated_by_language(model):
    assert cut_between(np.array([0.0, 1.0]), np.array([3.0, 4.0])) == 2.0
    assert 1 < cut_between(np.array([0.0, 1.0, 9.0]), np.array([2.0, 3.0])) < 2
    assert len(model.cuts) == len(model.languages) == 2 and model.cuts[0] != model.cuts[1]
    rows = made(200, 7)
    got, lang = Scorer(model)([r[1] for r in rows])
    assert [model.languages[k] for k in lang] == [r[2] for r in rows]
    assert (((got >= 0.3) == [r[3] == 1 for r in rows])).mean() > 0.98


def test_no_model_without_both_labels():
    assert fit(["a b"], [1], ["x"]) is None and fit([], [], []) is None
    one = fit(["bad word", "good word"] * 4, [1, 0] * 4, [None] * 8)
    assert one.languages == [] and 0 <= Scorer(one)(["bad", None])[0].min() <= 1


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = judge_toxicity(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    p = got.join(labels, "doc_id", "left").toPandas()
    assert len(p) == docs.count() and p.score.between(0, 1).all() and ((p.score >= 0.3) == (p.predicted == 1)).all()
    held = p[p.held_out & p.toxic.notna()]
    bad, good = held.score[held.toxic == 1].values, held.score[held.toxic == 0].values
    assert ((bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean()) > 0.96
    assert (held.predicted == held.toxic).mean() > 0.97 and held.predicted[held.toxic == 1].mean() > 0.9


def test_hard_documents_and_sample(spark, monkeypatch):
    rows = hard_docs() + [(1000 + i, t, lang, "s", 1) for i, t, lang, _ in made(200)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    labels = spark.createDataFrame([(1000 + i, 1, y) for i, _, _, y in made(200)]
                                   + [(None, 1, 1), (5, None, None), (7, 1, 9), (50, 0, 1), (50, 0, 1)], LABELS)
    got = judge_toxicity(docs, clashing(labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.doc_id: r.score for r in got}
    assert by[40] == by[41] == by[None] and all(0 <= r.score <= 1 for r in got)
    picked = sample(docs, labels, F.lit(True))
    assert len(picked) == 201 and sum(y for _, y, _ in picked) == 51  # the repeated row once
    monkeypatch.setattr(T, "TRAIN_DOCS", 20)
    many = spark.createDataFrame([(3, f"text {i}", "en", "s", 1) for i in range(3000)] + [(4, "x", "en", "s", 1)], DOCS)
    two = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], LABELS)
    few = sample(many, two, F.lit(True))
    assert len([r for r in few if r[1] == 1]) == 20 and sum(r[1] == 0 for r in few) == 1


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert judge_toxicity(empty, none).count() == 0
    bare = judge_toxicity(spark.createDataFrame(hard_docs(), DOCS), none)
    assert {(r.score, r.predicted) for r in bare.collect()} == {(0.0, 0)}


def test_learns_from_every_whole_text(spark, monkeypatch):
    """Buckets, languages and cuts come from all labelled texts, also past the driver's sample and its text length."""
    monkeypatch.setattr(T, "TRAIN_DOCS", 60)
    monkeypatch.setattr(T, "TRAIN_BYTES", 40)
    rows = made(800) + [(900 + i, "ta " * 30 + "latestword", "cc", i % 2) for i in range(4)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], LABELS)
    model = T.train(docs.repartition(5), labels, F.lit(True))
    met = np.concatenate([np.unique(hashed(sorted(set(words_of(t))))) for _, t, _, _ in rows])
    buckets, n = np.unique(met, return_counts=True)
    assert model.buckets.tolist() == buckets[n >= T.MIN_COUNT].tolist() and model.languages == ["aa", "bb", "cc"]
    assert np.isin(hashed([b"latestword"])[0], model.buckets).all()
    fresh = made(200, 7)
    assert (((Scorer(model)([r[1] for r in fresh])[0] >= 0.3) == [r[3] == 1 for r in fresh])).mean() > 0.97
    again = T.train(docs.repartition(2), labels, F.lit(True))
    assert (again.embed == model.embed).all() and (again.cuts == model.cuts).all() and (again.out == model.out).all()


def test_peaks_of_long_texts(monkeypatch):
    rng = np.random.default_rng(4)
    rows = made(40, 2)
    model = fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    _, lens = padded([np.arange(n) for n in (50, 0, 3, 17)])
    x = rng.normal(0, 1, (int(lens.sum()) + 2 * len(lens), T.WIDTH))
    want = T.peaks(x, lens, model)
    monkeypatch.setattr(T, "STEP_WORDS", 7)
    got = T.peaks(x, lens, model)
    assert all(np.allclose(a, b) for g, w in zip(got, want) for a, b in zip(g, w))
