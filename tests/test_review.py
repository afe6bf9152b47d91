"""Inputs the tables lack: gaps, repeats, tight cells, nothing at all."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.functions.text import is_regular_report, trimmed
from textmatch.operators import matching as M, neighbours as N, pretraining as P, records as R
from textmatch.operators.vocabulary import number_tokens
from textmatch.options import DEFAULTS
from textmatch.plans import indexing
from textmatch.session import fresh_path
from textmatch.sources import readers, writers

VECTORS = "file_id bigint, vec_id bigint, token string, embedding array<float>"
QUERIES = "doc_id bigint, query_id bigint, embedding array<float>"


def test_masking_keeps_instances_without_a_fitting_word(spark):
    rows = [
        (0, 1, 0, ["[CLS]", "aa", "##b", "##c", "[SEP]", "cc", "##d", "##e", "[SEP]"]),
        (0, 2, 0, ["[CLS]", "x", "y", "[SEP]", "z", "[SEP]"]),
    ]
    df = spark.createDataFrame(rows, "round int, doc_id bigint, start int, tokens array<string>")
    vocab = spark.createDataFrame([(t, 1000 + 7 * i) for i, t in enumerate("x y z aa cc ##b".split())], "token string, id int")
    got = {r.doc_id: r for r in P.masked(P.picked_positions(df), vocab).collect()}
    assert set(got) == {1, 2} and got[1].tokens == rows[0][3] and got[1].masked_lm_positions == []
    assert len(got[2].masked_lm_positions) == 1


def test_random_tokens_come_from_a_vocabulary_with_gaps(spark):
    tokens = ["[CLS]"] + [f"t{i}" for i in range(60)] + ["[SEP]"]
    df = spark.range(200).select(F.lit(0).alias("round"), F.col("id").alias("doc_id"), F.lit(0).alias("start"),
                                 F.array(*[F.lit(t) for t in tokens]).alias("tokens"))
    vocab = spark.createDataFrame([(f"r{i}", 1000 + 3 * i) for i in range(500)], "token string, id int")
    rows = P.masked(P.picked_positions(df), vocab).collect()
    new = [r.tokens[p] for r in rows for p in r.masked_lm_positions]
    masks, randoms = sum(t == "[MASK]" for t in new), sum(t.startswith("r") for t in new)
    assert 0.76 < masks / len(new) < 0.84 and 0.07 < randoms / len(new) < 0.13


def test_vector_ids_are_unique_or_refused(spark):
    layers = "layers:array<struct<index:bigint,values:array<double>>>"
    schema = f"file_id bigint, linex_index bigint, features array<struct<token:string,{layers}>>"
    feature = ("t", [(-i, [1.0]) for i in range(24)])
    rows = R.unnest(spark.createDataFrame([(0, 5, [feature] * 2)], schema))
    assert rows.count() == 48 == rows.select("vec_id").distinct().count()
    with pytest.raises(Exception, match="too large for a vector id"):
        R.unnest(spark.createDataFrame([(0, 1 << 31, [feature])], schema)).collect()


def test_adaptive_k_of_many_files(spark):
    files = spark.createDataFrame([(30_000_000,)], "n_files bigint")
    assert M.adaptive_k(files).first().k == 3_000_000_000


def test_hits_find_their_own_file(spark):
    hits = spark.createDataFrame([(1, 10, 0), (1, 10, 0), (2, 11, 0)], "doc_id bigint, file_id bigint, vec_id bigint")
    files = spark.createDataFrame([(10, 0, "a"), (11, 0, "b")], "file_id bigint, vec_id bigint, file string")
    assert {(r.doc_id, r.file, r.n) for r in M.attribute_by_id(hits, files).collect()} == {(1, "a", 2), (2, "b", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_tight_cells_lose_no_hit(spark, seed):
    """Cells of near copies, queries right at the threshold, and zero vectors."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((5, 16))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    near = centre[np.arange(200) % 5] + 2e-4 * rng.standard_normal((200, 16))
    side = rng.standard_normal((60, 16))
    own = centre[np.arange(60) % 5]
    side -= (side * own).sum(1, keepdims=True) * own
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(0.9) + rng.normal(scale=5e-4, size=60)[:, None]
    queries = np.cos(angle) * own + np.sin(angle) * side
    unit = lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).astype("float32")
    near, queries = unit(near), unit(queries)
    near[7] = 0
    corpus = spark.createDataFrame([(i % 3, i, "", v.tolist()) for i, v in enumerate(near)], VECTORS)
    asked = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(queries)], QUERIES)
    cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], N.CENTROID_SCHEMA)
    index = indexing.build_index(corpus, fresh_path(spark, "index"), centroids=cells)
    got = N.above_threshold(asked, index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 0.9, None, index.statistics)
    scores = np.round(queries.astype(float) @ near.astype(float).T, 6)
    want = set(zip(*np.nonzero(scores > 0.9)))
    assert {(r.query_id, r.vec_id) for r in got.collect()} == want
    counted = N.count_above_threshold(asked, index.vectors, index.centroids, M.QUERY_IDS, "file_id", 0.9, index.statistics, 32)
    by_file = {}
    for q, c in want:
        by_file[q, c % 3] = by_file.get((q, c % 3), 0) + 1
    sums = counted.groupBy("query_id", "file_id").agg(F.sum("n").alias("n")).collect()
    assert {(r.query_id, r.file_id): r.n for r in sums} == by_file


def test_equal_vectors_are_grouped_by_value(spark):
    v = [1.0, 0.0]
    asked = spark.createDataFrame([(d, q, v if q % 2 else [0.0, 1.0]) for d in range(4) for q in range(6)], QUERIES)
    corpus = spark.createDataFrame([(9, 1, "", v), (9, 2, "", v), (8, 1, "", [0.0, 1.0])], VECTORS)
    index = indexing.build_index(corpus, fresh_path(spark, "index"), replace(DEFAULTS, clusters=2))
    got = {(r.doc_id, r.file_id): r.hits for r in indexing.similarity(asked, index, k=5).collect()}
    assert got == {(d, f): n for d in range(4) for f, n in ((9, 6), (8, 3))}


@pytest.mark.parametrize("rows", [[], [(0, 1, "", [0.0, 0.0])]])
def test_corpus_without_directions(spark, rows):
    index = indexing.build_index(spark.createDataFrame(rows, VECTORS), fresh_path(spark, "index"))
    asked = spark.createDataFrame([(0, 0, [1.0, 0.0])], QUERIES)
    assert indexing.similarity(asked, index).count() == 0


def test_documents_without_sentences_are_done(spark):
    docs = spark.createDataFrame([(1, "word " * 40 + "."), (2, "too short.")], "doc_id bigint, text string")
    path = fresh_path(spark, "clean")
    writers.write_clean_texts(docs, path)
    writers.write_clean_texts(docs, path)
    got = {r.doc_id: r.text for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == 2 and got[2] == "" and got[1].startswith("word")


def test_malformed_records_fail(spark):
    path = fresh_path(spark, "json")
    spark.createDataFrame([("{not json",)], "value string").write.text(path)
    with pytest.raises(Exception):
        readers.read_embeddings(spark, path).collect()


def test_documents_of_a_corpus_have_their_own_numbers(spark):
    path = fresh_path(spark, "corpus")
    spark.createDataFrame([(i, f"line {i}\n \nother \n") for i in range(40)], "i int, value string").select("value").repartition(5).write.text(path)
    got = readers.read_training_corpus(spark, path)
    assert got.select("file", "doc_no").distinct().count() == got.select("doc_id").distinct().count()
    assert {r.line for r in got.collect()} == {f"line {i}" for i in range(40)} | {"other"}


def test_tokens_are_numbered_without_a_global_window(spark):
    rows = [(0, 0, "[PAD]"), (0, 1, "[UNK]")] + [(1, 0, t) for t in ("a", "ab", "b", "é", "漢", "aaaaaaa", "aaaaaab", "##a", "Z")]
    numbered = number_tokens(spark.createDataFrame(rows, "kind int, place int, token string"))
    want = {t: i for i, (_, _, t) in enumerate(sorted(rows))}
    assert {r.token: r.id for r in numbered.collect()} == want
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    data = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    assert len(data) <= 2  # the coarsest prefixes only


def test_texts(spark):
    df = spark.createDataFrame([("  a b　\n",)], "t string")
    assert df.select(trimmed(F.col("t"))).first()[0] == "a b"
    df = spark.createDataFrame([("B.B B.B",)], "t string")
    assert df.select(is_regular_report(F.col("t"), 3, "B.B")).first()[0] and not df.select(is_regular_report(F.col("t"), 2, "B.B")).first()[0]
