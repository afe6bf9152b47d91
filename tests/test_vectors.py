"""Neighbours and scores against brute force."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.functions.vectors import normalise
from textmatch.operators import matching as M, neighbours as N, positions as G
from textmatch.operators.skew import lookup_join
from textmatch.options import DEFAULTS
from textmatch.plans import indexing
from textmatch.session import fresh_path


def unit(rows):
    m = np.asarray(rows, float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0).astype("float32")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 8))
    c = unit(centre[rng.integers(0, 6, 240)] + 0.4 * rng.standard_normal((240, 8)))
    c[5] = 0  # a zero vector
    c[10:90] = c[10]  # a third of the corpus is one vector
    q = unit(centre[rng.integers(0, 6, 50)] + 0.4 * rng.standard_normal((50, 8)))
    q[:17] = c[10]  # a third of the queries is that vector, too
    corpus = [(i % 7, i, "", v.tolist()) for i, v in enumerate(c)]
    queries = [(i % 3, i, v.tolist()) for i, v in enumerate(q)]
    cdf = spark.createDataFrame(corpus, "file_id bigint, vec_id bigint, token string, embedding array<float>")
    qdf = spark.createDataFrame(queries, "doc_id bigint, query_id bigint, embedding array<float>")
    index = indexing.build_index(cdf, fresh_path(spark, "index"), replace(DEFAULTS, clusters=6))
    scores = np.round(q.astype(float) @ c.astype(float).T, 6)
    return qdf, index, scores


def brute(scores, k, threshold=-9):
    out = set()
    for i, row in enumerate(scores):
        order = sorted((j for j in range(len(row)) if row[j] > threshold), key=lambda j: (-row[j], j % 7, j))
        out |= {(i, j) for j in order[:k]}
    return out


def ids(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def test_threshold_is_exact_in_small_blocks(data):
    q, index, scores = data
    for k in (None, 4):
        got = N.above_threshold(
            q, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 0.8, k, index.statistics, block_rows=16
        )
        assert ids(got) == brute(scores, k, 0.8)


def test_nearest_is_exact(data):
    q, index, scores = data
    for k in (3, 500):
        got = N.nearest(q, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, k, block_rows=32)
        assert ids(got) == brute(scores, k)


def test_more_probes_find_more(data):
    q, index, scores = data
    want = brute(scores, 5)
    found = [
        len(want & ids(N.nearest(q, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 5, nprobe=p)))
        for p in (1, 6)
    ]
    assert found[0] <= found[1] == len(want)


def test_similarity_counts_copies(data):
    q, index, scores = data
    options = replace(DEFAULTS, threshold=0.8)
    got = {(r.doc_id, r.file_id): r.hits for r in indexing.similarity(q, index, options, k=6).collect()}
    want = {}
    for i, j in brute(scores, 6, 0.8):
        want[i % 3, j % 7] = want.get((i % 3, j % 7), 0) + 1
    assert got == want


def test_no_hits_and_no_vectors(spark, data):
    q, index, _ = data
    docs = spark.createDataFrame([(0,), (1,), (9,)], "doc_id bigint")
    percents = indexing.similarity(q, index, replace(DEFAULTS, threshold=1.5))
    got = {r.doc_id: r.plagiarism_status for r in M.verdicts(docs, M.vectors_per_document(q), percents).collect()}
    assert got == {0: "False", 1: "False", 9: M.UNREADABLE}


def test_no_cross_product_in_plan(data):
    q, index, _ = data
    plan = indexing.similarity(q, index)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [list(r[0]) for r in df.select(normalise(F.col("v"))).collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])


def test_lookup_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(600)], "i int, k string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    lookup = left.select("k").distinct().withColumn("v", F.length("k"))
    rows = lookup_join(left, lookup, "k", counts, F.col("i")).collect()
    assert len(rows) == 600 and all(r.v == len(r.k) for r in rows)


def test_positions_and_offsets(spark):
    keys = [3, 5, 1 << 17, (1 << 40) + 1, (1 << 50), 8, 9, (1 << 17) + 1]
    df = spark.createDataFrame([(k, k % 5 + 1) for k in keys], "file_id bigint, n_vectors bigint")
    got = {r.file_id: r.position for r in G.position_by_id(df, "file_id").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    offsets = G.file_offsets(df)
    ends = {r.file_id: (r.start_off, r.end_off) for r in offsets.collect()}
    at = 0
    for k in sorted(keys):
        assert ends[k] == (at, at + k % 5 + 1)
        at += k % 5 + 1
    hits = spark.range(at).select(F.lit(1).alias("doc_id"), F.col("id").alias("position"))
    found = {r.position: r.file_id for r in M.attribute_by_offsets(hits, offsets).collect()}
    assert found == {p: k for k, (a, b) in ends.items() for p in range(a, b)}
