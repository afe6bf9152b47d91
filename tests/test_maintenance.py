"""An index after many small batches and a cell that outgrew the rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.operators import matching as M, neighbours as N
from textmatch.plans import maintenance
from textmatch.session import fresh_path
from textmatch.sources.readers import newest_manifest, read_index
from textmatch.sources.writers import write_index, write_vectors

from test_vectors import brute, ids, unit


def files(spark, path, index):
    return index.vectors.select(F.input_file_name().alias("f")).distinct().count()


def test_compaction_keeps_vectors_and_results(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((8, 10))
    own = np.where(np.arange(700) < 200, rng.integers(0, 8, 700), 0)  # what comes later is all alike
    c = unit(centre[own] + 0.35 * rng.standard_normal((700, 10)))
    q = unit(centre[rng.integers(0, 8, 20)] + 0.3 * rng.standard_normal((20, 10)))
    scores = np.round(q.astype(float) @ c.astype(float).T, 6)
    corpus = spark.createDataFrame(
        [(i % 7, i, "", v.tolist()) for i, v in enumerate(c)], "file_id bigint, vec_id bigint, token string, embedding array<float>"
    )
    queries = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(q)], "doc_id bigint, query_id bigint, embedding array<float>")
    path = fresh_path(spark, "index")
    centroids = spark.createDataFrame(N.train_centroids(corpus.filter("vec_id < 200"), 8).collect(), N.CENTROID_SCHEMA)
    write_index(corpus.filter("vec_id < 100"), centroids, path)
    for b in range(6):
        write_vectors(corpus.filter(f"vec_id >= 100 + {b} * 100 AND vec_id < 200 + {b} * 100"), centroids, path, f"run-{b}")

    search = lambda index, **kw: ids(N.nearest(
        queries, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 10, blocks=index.blocks, statistics=index.statistics, **kw
    ))
    before = read_index(spark, path)
    largest, n_files = before.statistics.agg(F.max("n_vectors")).first()[0], files(spark, path, before)
    want = brute(scores, 10)
    after = maintenance.compact_index(spark, path, overfull=2.0)
    assert newest_manifest(spark, path)[0] == 1
    assert sorted(r.vec_id for r in after.vectors.select("vec_id").collect()) == list(range(700))
    assert after.vectors.select("batch").distinct().count() == 1
    assert files(spark, path, after) < n_files / 2
    assert after.statistics.agg(F.max("n_vectors")).first()[0] < largest
    retired = {r.cell for r in before.centroids.collect()} - {r.cell for r in after.centroids.collect()}
    assert retired and after.vectors.filter(F.col("cell").isin(sorted(retired))).count() == 0
    assert search(after) == want
    # As many vectors read as before: two halves in place of one cell.
    assert len(search(after, nprobe=4) & want) >= 0.97 * len(search(before, nprobe=2) & want)

    # A writer that still knows the old centres adds to a cell that was split; nothing is lost.
    write_vectors(corpus.withColumn("vec_id", F.col("vec_id") + 1000), centroids, path, "run-late")
    grown = read_index(spark, path)
    twice = {(i, j) for i, j in search(grown)}
    doubled = np.concatenate((scores, scores), axis=1)
    order = {i: sorted(range(1400), key=lambda j, i=i: (-doubled[i, j], (j % 700) % 7, j if j < 700 else j + 300))[:10] for i in range(20)}
    assert twice == {(i, j if j < 700 else j + 300) for i, js in order.items() for j in js}
    maintenance.drop_replaced(spark, path)
    assert search(read_index(spark, path)) == twice


def test_nothing_to_do_and_lost_races(spark):
    path = fresh_path(spark, "index")
    rows = spark.createDataFrame([(1, i, "", [1.0, 0.0]) for i in range(20)], "file_id bigint, vec_id bigint, token string, embedding array<float>")
    write_index(rows, N.train_centroids(rows, 1), path)
    maintenance.compact_index(spark, path)
    assert newest_manifest(spark, path)[0] == 0  # one batch, one cell, one direction
    maintenance.publish(spark, path, 1, {"centroids": "centroids", "replaced": [], "split": []})
    with pytest.raises(RuntimeError, match="another run"):
        maintenance.publish(spark, path, 1, {"centroids": "centroids", "replaced": [], "split": []})
