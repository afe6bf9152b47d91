"""The classifier chain: accuracy on held-out rows, and awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from textmatch.llm import toxicity

from .cases import DOC_SCHEMA, documents, document_rows, say, with_clashes

BAD = [t for group in toxicity.TERMS.values() for t in group]


def corpus(n=600, seed=5):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 7 == 0
        ws = say(draw, draw.randint(5, 120), 3000).split()
        for _ in range(draw.randint(1, 5) if toxic else 0):
            ws.insert(draw.randint(0, len(ws)), draw.choice(BAD).capitalize() + draw.choice(("", "!", "***")))
        rows.append((10_000 + i, " ".join(ws), "en", "a", 1, int(toxic)))
    return rows


def test_unseen_rows(spark):
    rows = corpus()
    docs = documents(spark, [r[:5] for r in rows] + document_rows())
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2], "doc_id long, toxic int")
    labels = with_clashes(labels.union(spark.createDataFrame([(None, 1), (10_001, None), (77, 1)], "doc_id long, toxic int")))
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(scored) == len(rows) + len(document_rows())
    truth = {r[0]: r[5] for r in rows}
    held = [(truth[r["doc_id"]], r["toxicity"]["toxic"] >= 0.5) for r in scored if r["doc_id"] in truth and r["doc_id"] % 2 == 0]
    assert np.mean([t == bool(p) for t, p in held]) > 0.97
    assert not any(p for t, p in held if not t)


def test_accepted_keeps_clean_rows_as_they_are(spark):
    rows = corpus()
    docs = documents(spark, [r[:5] for r in rows] + document_rows())
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    clean = {r[0] for r in rows if not r[5]} | {r[0] for r in document_rows()}
    assert docs.filter(F.col("doc_id").isin([i for i in clean if i]) | F.col("doc_id").isNull()).exceptAll(kept).count() == 0
    assert kept.filter(F.col("doc_id") >= 10_000).count() <= len(clean) + 3


def test_without_both_labels_nothing_goes(spark):
    docs = documents(spark)
    for labels in ([], [(4, 0), (5, 0)], [(4, 1)]):
        kept = toxicity.accepted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert kept.count() == docs.count()
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert toxicity.accepted(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_chain_feeds_earlier_probabilities():
    draw = np.random.default_rng(0)
    features = [np.unique(draw.integers(0, 50, 20)) for _ in range(300)]
    y = np.array([[int(5 in f), int(7 in f), int(5 in f or 7 in f)] for f in features])
    chain = toxicity.train(np.arange(50, dtype=np.uint64), features, y, np.arange(300) % 5)
    assert [len(w) for w in chain.weights] == [51, 52, 53]
    assert chain.weights[2][51:].min() > 0  # both earlier probabilities speak for the last


def test_words_of_a_text_that_spans_buffers(monkeypatch):
    from textmatch.llm import words as module

    text = say(random.Random(1), 3000, 50)
    one = toxicity.distinct_rows(*toxicity.text_words([text, None, "a b"]))
    buffers = module.buffers
    monkeypatch.setattr(toxicity, "buffers", lambda t: buffers(t, 500))
    two = toxicity.distinct_rows(*toxicity.text_words([text, None, "a b"]))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
