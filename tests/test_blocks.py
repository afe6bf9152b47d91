"""Coarse cells of centres, stored blocks and what a search reads."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.operators import matching as M, neighbours as N
from textmatch.options import DEFAULTS
from textmatch.plans import indexing
from textmatch.session import fresh_path
from textmatch.sources.readers import read_index
from textmatch.sources.writers import write_index

from test_vectors import brute, ids, unit


@pytest.fixture(scope="module")
def clusters(spark):
    """Tight clusters, a third of all rows in one of them; a zero vector and copies."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((30, 12))
    own = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 30, 900))
    c = unit(centre[own] + 0.15 * rng.standard_normal((900, 12)))
    c[7] = 0
    c[100:160] = c[100]
    q = unit(np.concatenate((centre[:10] + 0.1 * rng.standard_normal((10, 12)), c[100:101], np.zeros((1, 12)))))
    corpus = spark.createDataFrame(
        [(i % 7, i, "", v.tolist()) for i, v in enumerate(c)], "file_id bigint, vec_id bigint, token string, embedding array<float>"
    )
    queries = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(q)], "doc_id bigint, query_id bigint, embedding array<float>")
    return corpus, queries, np.round(q.astype(float) @ c.astype(float).T, 6)


@pytest.fixture(scope="module")
def index(spark, clusters):
    path = fresh_path(spark, "index")
    write_index(clusters[0], N.train_centroids(clusters[0], 8), path, block_rows=16)
    return read_index(spark, path)


def test_blocks_hold_all_vectors(index, clusters):
    rows = index.vectors.collect()
    assert sorted(r.vec_id for r in rows) == list(range(900))
    heads = {(r.cell, r.block): r for r in index.blocks.collect()}
    assert len(heads) > 40 and sum(h.n_vectors for h in heads.values()) == 900
    for r in rows:
        scores = {b: round(float(np.dot(np.array(h.centre, float), np.array(r.embedding, float))), 6) for (c, b), h in heads.items() if c == r.cell}
        assert abs(scores[r.block] - max(scores.values())) < 2e-6 and abs(scores[r.block] - r.block_score) < 2e-6
        assert not any(r.embedding) or r.block_score >= heads[r.cell, r.block].min_score


@pytest.mark.parametrize("threshold, k", [(0.9, 5), (-0.1, None)])
def test_results_with_blocks_are_exact(index, clusters, threshold, k):
    _, q, scores = clusters
    got = N.above_threshold(
        q, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, threshold, k, index.statistics, block_rows=8, blocks=index.blocks
    )
    assert ids(got) == brute(scores, k or 900, threshold)


def test_nearest_and_counts_with_blocks_are_exact(index, clusters):
    _, q, scores = clusters
    near = N.nearest(
        q, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 7, blocks=index.blocks, statistics=index.statistics
    )
    assert ids(near) == brute(scores, 7)
    counted = N.count_above_threshold(
        q, index.vectors, index.centroids, M.QUERY_IDS, "file_id", 0.9, index.statistics, blocks=index.blocks
    )
    got = {}
    for r in counted.collect():
        got[r.query_id, r.file_id] = got.get((r.query_id, r.file_id), 0) + r.n
    want = {}
    for i, j in brute(scores, 900, 0.9):
        want[i, j % 7] = want.get((i, j % 7), 0) + 1
    assert got == want


def test_few_blocks_are_visited(index, clusters):
    """A search above 0.9 meets a small part of the blocks, and no vector of another one moves."""
    _, q, _ = clusters
    q = q.limit(10)
    probed = N.probe_reachable(q.withColumn("floor", F.lit(0.9)), index.centroids, index.statistics, F.col("floor"))
    reached = N.heads_reached(probed, N._lowest(index.blocks), ["batch", "block"])
    pairs = probed.join(index.blocks.select("cell", F.col("block").alias("other")), "cell").count()
    assert 0 < reached.count() < 0.7 * pairs
    moved = N._visited(index.vectors, reached, N.BLOCK_KEYS)
    blocks = {(r.cell, r.block) for r in reached.select("cell", "block").distinct().collect()}
    assert {(r.cell, r.block) for r in moved.select("cell", "block").distinct().collect()} == blocks
    assert len(blocks) < 0.8 * index.blocks.count()


def test_one_probe_reads_one_folder(index, clusters):
    _, q, _ = clusters
    one = q.filter("query_id = 1")
    found = N.above_threshold(
        one, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 0.5, 5, index.statistics, nprobe=1, blocks=index.blocks
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "isnotnull(cell" in plan
    probed = N.probe_closest(one, index.centroids, 1)
    cell = probed.first().cell
    read = N._visited(index.vectors, probed, ["cell"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all(f"/cell={cell}/" in r.f for r in read)
    scans = N._visited(index.vectors, probed, ["cell"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans and "cell#" in scans.split("PartitionFilters", 1)[1]


def test_more_batches_than_one(spark, clusters, index):
    """Heads name their batch, so blocks of several batches do not mix."""
    from textmatch.sources.writers import write_vectors

    corpus, q, scores = clusters
    path = fresh_path(spark, "index")
    write_index(corpus.filter("vec_id % 3 = 0"), index.centroids, path, block_rows=16)
    for part in (1, 2):
        write_vectors(corpus.filter(f"vec_id % 3 = {part}"), index.centroids, path, f"later-{part}", block_rows=16)
    grown = read_index(spark, path)
    got = N.above_threshold(
        q, grown.vectors, grown.centroids, M.QUERY_IDS, M.CORPUS_IDS, 0.8, 9, grown.statistics, blocks=grown.blocks
    )
    assert ids(got) == brute(scores, 9, 0.8)


def test_many_centres_equal_few(spark, clusters, monkeypatch):
    """With a cap of 1 KB the centres are searched through coarse cells of their own."""
    corpus, q, scores = clusters
    centroids = spark.createDataFrame(N.train_centroids(corpus, 60).collect(), N.CENTROID_SCHEMA)
    statistics = spark.createDataFrame(N.cell_statistics(N.assign_cells(corpus, centroids)).collect(), "cell int, n_vectors long, min_score double")
    floored = q.withColumn("floor", F.when(F.col("query_id") % 2 == 0, 0.9).otherwise(0.3))

    def results():
        assigned = sorted((r.vec_id, r.cell, r.cell_score) for r in N.assign_cells(corpus, centroids).collect())
        closest = sorted((r.query_id, r.cell) for r in N.probe_closest(q, centroids, 5).collect())
        every = sorted((r.query_id, r.cell) for r in N.probe_closest(q, centroids, 1 << 30).collect())
        reachable = {(r.query_id, r.cell) for r in N.probe_reachable(floored, centroids, statistics, F.col("floor")).collect()}
        return assigned, closest, every, reachable

    few = results()
    monkeypatch.setattr(N, "MAX_CENTROID_BYTES", 1024)
    assert not N.few(centroids)
    many = results()
    assert many == few
    got = N.above_threshold(q, N.assign_cells(corpus, centroids), centroids, M.QUERY_IDS, M.CORPUS_IDS, 0.8, 9)
    assert ids(got) == brute(scores, 9, 0.8)


def test_whole_index_with_many_centres(spark, clusters, monkeypatch):
    monkeypatch.setattr(N, "MAX_CENTROID_BYTES", 1024)
    corpus, q, scores = clusters
    built = indexing.build_index(corpus, fresh_path(spark, "index"), replace(DEFAULTS, clusters=40))
    got = {(r.doc_id, r.file_id): r.hits for r in indexing.similarity(q, built, replace(DEFAULTS, threshold=0.8), k=6).collect()}
    want = {}
    for i, j in brute(scores, 6, 0.8):
        want[i % 3, j % 7] = want.get((i % 3, j % 7), 0) + 1
    assert got == want
