"""Corpora of many equal vectors, and sums over shared vectors, against plain Python."""

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from textmatch.operators import matching as M, neighbours as N
from textmatch.options import DEFAULTS
from textmatch.plans import indexing
from textmatch.session import fresh_path

KINDS = 12


@pytest.fixture(scope="module")
def tokens(spark):
    """Vectors of few kinds, one of them a third of all; some kinds have the same score with others."""
    rng = np.random.default_rng(5)
    kinds = np.vstack([np.eye(4), -np.eye(4)[:2], rng.standard_normal((KINDS - 6, 4))])
    kinds = (kinds / np.linalg.norm(kinds, axis=1, keepdims=True)).astype("float32")
    of = np.where(np.arange(400) % 3 == 0, 0, rng.integers(0, KINDS, 400))
    asked = rng.integers(0, KINDS, 60)
    corpus = [(int(i * 7 % 11), i, "", kinds[c].tolist()) for i, c in enumerate(of)]
    queries = [(i % 5, i, kinds[c].tolist()) for i, c in enumerate(asked)]
    cdf = spark.createDataFrame(corpus, "file_id bigint, vec_id bigint, token string, embedding array<float>")
    qdf = spark.createDataFrame(queries, "doc_id bigint, query_id bigint, embedding array<float>")
    index = indexing.build_index(cdf, fresh_path(spark, "index"), replace(DEFAULTS, clusters=3))
    scores = np.round(kinds.astype(float) @ kinds.astype(float).T, 6)
    best = lambda c, k, low: sorted(
        ((-scores[c, d], f, i) for d, (f, i, *_) in zip(of, corpus) if scores[c, d] > low))[:k]
    return qdf, index, queries, asked, best


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
@pytest.mark.parametrize("low", [-2.0, 0.3])
def test_best_rows_of_equal_vectors(tokens, k, low):
    qdf, index, queries, asked, best = tokens
    found, most = N.above_threshold_by_value(
        qdf, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, low, k, index.statistics, block_rows=16, blocks=index.blocks
    )
    got = sorted((r.query_id, r["rank"], r.file_id, r.vec_id) for r in found.collect())
    want = sorted((q[1], n + 1, f, i) for q, c in zip(queries, asked) for n, (_, f, i) in enumerate(best(c, k, low)))
    assert got == want and most == len(want)


def test_few_rows_of_a_vector_are_moved(tokens):
    _, index, *_ = tokens
    kept = N.first_copies(index.vectors, M.CORPUS_IDS, 7)
    assert kept.count() <= 7 * KINDS < index.vectors.count()
    assert kept.filter("_copy = 1").count() == KINDS


def test_percentages_of_equal_vectors(tokens):
    qdf, index, queries, asked, best = tokens
    rows = indexing.similarity(qdf, index, replace(DEFAULTS, threshold=0.3), k=20)
    want = Counter((q[0], f) for q, c in zip(queries, asked) for _, f, _ in best(c, 20, 0.3))
    assert {(r.doc_id, r.file_id): r.hits for r in rows.collect()} == want
    # No row per document, vector and file is made: sums come from blocks of both sides.
    assert "FlatMapGroupsInArrow" in rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("block, cells", [(1 << 20, 1 << 21), (50, 1 << 21), (50, 8), (1 << 20, 1)])
def test_sums_over_a_key(spark, monkeypatch, block, cells):
    monkeypatch.setattr(N, "SUM_ROWS", block)
    rng = np.random.default_rng(block + cells)
    left = [(f"d{rng.integers(20)}" if rng.random() > 0.05 else None, int(rng.integers(9)), int(rng.integers(1, 5))) for _ in range(200)]
    right = [(int(rng.integers(7)), int(rng.integers(30)), int(rng.integers(1, 1 << 40))) for _ in range(150)]
    want = Counter()
    for a, x, n in left:
        for y, b, m in right:
            if x == y:
                want[a, b] += n * m
    l = spark.createDataFrame(left, "a string, x bigint, n bigint")
    r = spark.createDataFrame(right, "x bigint, b bigint, m bigint")
    rows = N.block_sums(l, r, "x", ("a", "b"), ("n", "m"), (len(left), len(right))).collect()
    assert {(s.a, s.b): s.n for s in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("cells", [1 << 21, 40, 1])
def test_sums_of_one_place_in_steps(monkeypatch, cells):
    import pyarrow as pa

    monkeypatch.setattr(N, "SUM_CELLS", cells)
    rng = np.random.default_rng(cells)
    doc, key, n = rng.integers(0, 9, 80), rng.integers(0, 5, 80), rng.integers(1, 4, 80)
    file, at, m = rng.integers(0, 300, 70), rng.integers(0, 6, 70), rng.integers(1, 1 << 40, 70)
    want = Counter()
    for a, x, i in zip(doc, key, n):
        for b, y, j in zip(file, at, m):
            if x == y:
                want[int(a), int(b)] += int(i) * int(j)
    x, y = pa.table({"_key": key, "_n": n, "a": doc}), pa.table({"_key": at, "_n": m, "b": file})
    got = [r for batch in N._sums(x, y, "a", "b") for r in batch.to_pylist()]
    assert {(r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want)
