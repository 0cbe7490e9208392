import zlib

import numpy as np
import pytest

from twinframe.llm.toxicity import fit_linear, held_out, toxicity_scores


@pytest.fixture
def corpus(spark, frame, prose):
    """Half of the documents carry one of four words; their labels say so."""
    bad = ["moron", "scumbag", "worthless", "clowns"]
    texts = []
    for i in range(400):
        w = prose(30, i).split()
        if i % 2:
            w[i % 30] = bad[i // 2 % 4].upper()
        texts.append(" ".join(w))
    docs = frame(texts + [(1000, None), (1001, ""), (1002, "Moron, you are a clowns"), (1002, "Moron, you are a clowns"), (None, "moron")])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(300)] + [(7, 1, 1), (9, None, 1), (None, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    return docs, labels


def test_unlabelled_documents_are_told_apart(corpus):
    rows = toxicity_scores(*corpus).collect()
    assert len(rows) == 405
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert np.mean(right) > 0.98
    assert {r.doc_id: r.predicted for r in rows if r.doc_id is None or r.doc_id >= 1000} == {1000: 0, 1001: 0, 1002: 1, None: 1}


def test_held_out_labels_are_never_read(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", __import__("pyspark").sql.functions.when(held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    a, b = (sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity_scores(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_without_labels_or_documents(corpus):
    docs, labels = corpus
    assert {r.score for r in toxicity_scores(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity_scores(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity_scores(docs.where("false"), labels).collect() == []


def test_linear_fit():
    rng = np.random.default_rng(1)
    x = (rng.random((500, 6)) < 0.3).astype(float)
    p = 1 / (1 + np.exp(-(x @ [4, -4, 0, 0, 2, 0] - 1)))
    w, b = fit_linear(x, p)
    assert np.abs(1 / (1 + np.exp(-(x @ w + b))) - p).max() < 0.1
