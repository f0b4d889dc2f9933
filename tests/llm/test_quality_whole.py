"""Op 4 learns from every labelled document."""

import numpy as np
from pyspark.sql import functions as F

from shotloom.llm import quality as Q


def _tables(spark, n):
    docs = [(i, ("Good words of sense follow here number %d." % i) if i % 3 else "BAD!! %d $$ ##" % i) for i in range(n)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int"))


def test_all_documents_are_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(Q, "PAIRS", 10)
    docs, labels = _tables(spark, 90)
    rows = Q.labelled_features(docs, labels, F.col("doc_id") % 9 != 0)
    assert rows.count() == 80
    marks = rows.select("quality", "doc_id", F.array(F.col("doc_id").cast("double")).alias("x"))
    pairs, n = Q.preference_pairs(marks, {1: 60, 0: 20})
    got = [r.x[0] for r in pairs.collect()]
    assert n == len(got) == 60
    good, bad = sum(i for i in range(90) if i % 3), sum(i for i in range(90) if i % 3 == 0 and i % 9)
    assert sum(got) == good - 3 * bad  # every good document once, every bad one three times


def test_model_of_all_documents_is_exact(spark, monkeypatch):
    monkeypatch.setattr(Q, "PAIRS", 300)
    docs, labels = _tables(spark, 120)
    model = Q.train(docs, labels, F.lit(True))
    x = np.stack([Q.features(r.text.encode()) for r in docs.orderBy("doc_id").collect()])
    y = np.array([i % 3 > 0 for i in range(120)])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) < 1e-9, 1, x.std(0)))
    s = model.raw(x)
    assert np.allclose(model.grid, np.quantile(s, np.linspace(0, 1, Q.GRID)))
    assert ((model.score(x) >= Q.THRESHOLD) == y).all()
    assert Q.train(docs, labels.filter("quality = 1"), F.lit(True)) is None
