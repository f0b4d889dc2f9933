import itertools

import numpy as np
import pytest

from shotloom.llm.langid import chains, detect, forward_backward, label_languages, train
from pyspark.sql import functions as F

from llm_cases import DOCS, clashing, hard_docs

SF = "/root/testdata/sf0.01"


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    lens, n = np.array([3, 1, 4]), 3
    emit, trans = rng.random((8, n)) + 0.1, rng.random((n, n)) + 0.1
    post, pairs = forward_backward(emit, lens, trans, pairs=True)
    at, both = 0, np.zeros((n, n))
    for size in lens:
        e, total, marg = emit[at:at + size], 0.0, np.zeros((size, n))
        local = np.zeros((n, n))
        for path in itertools.product(range(n), repeat=int(size)):
            p = np.prod([e[i, y] for i, y in enumerate(path)]) * np.prod(
                [trans[a, b] for a, b in zip(path, path[1:])] or [1.0])
            total += p
            for i, y in enumerate(path):
                marg[i, y] += p
            for a, b in zip(path, path[1:]):
                local[a, b] += p
        assert np.allclose(post[at:at + size], marg / total)
        both += local / total
        at += size
    assert np.allclose(pairs, both)


def test_sentences():
    assert chains("One two. Three\n4 5!x") == [["one", "two"], ["three"], ["x"]]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return train(docs, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = detect(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_code_switch_and_edges(spark, model):
    rows = {"en": "The of and that with the thing was from the other.",
            "fr": "Que les des une vieux pour dans elle est la leur."}
    mixed = rows["en"] + " " + rows["fr"] + " " + rows["fr"]
    df = spark.createDataFrame(hard_docs() + [(90, rows["en"], None, None, 0), (91, rows["fr"], None, None, 0),
                                              (92, mixed, None, None, 0)], DOCS)
    got = label_languages(clashing(df), model)
    assert "extra" == got.filter("doc_id = 90").first().key
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert len(got.collect()) == df.count()
    for i, t in ((40, None), (41, ""), (42, " \n\t "), (47, "12 34 !!"), (None, None)):
        assert (by[i, t].lang_pred, by[i, t].score) == ("und", 0.0)
    assert by[90, rows["en"]].lang_pred == "en" and by[91, rows["fr"]].lang_pred == "fr"
    assert by[92, mixed].lang_pred == "fr" and by[92, mixed].score < 0.95


def test_no_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert detect(empty).count() == 0
    bare = spark.createDataFrame([(1, "the thing", None, None, 1)], DOCS)
    assert detect(bare).first().lang_pred == "und"
