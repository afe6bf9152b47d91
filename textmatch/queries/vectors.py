"""Embedding records, vector expressions, neighbours, the index and scoring."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import matching as M, neighbours as N, positions as G, records as R
from ..options import DEFAULTS, STOP_WORDS
from ..plans import checking, indexing
from ..plans.model import hashed_token_model
from ..session import fresh_path, written
from ..sources import readers, writers
from ..streaming.checking import check_stream, read_scores, score_stream
from ..streaming.indexing import extend_index
from .common import (
    K, LOW, SQL_CELLS, SQL_SCORED, SQL_UNIT, SQL_VOCAB, THRESHOLD, corpus_vectors, demo_index, demo_vocabulary,
    label_centroids, query, query_vectors, sql_hits, sql_pieces, sql_sentences, sql_occurrences, table,
)

# ---- records -----------------------------------------------------------------

# Each vector becomes a record of one token with two layers; some tokens are stop words.
WORDS = ("dan", "atau", "laut", "ombak", "karena", "pantai", "kapal", "untuk", "angin", "pasir")
_SQL_WORD = "CASE label " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"
SQL_RECORDS = f"""
rec AS (SELECT vec_id, label, {_SQL_WORD} AS token, embedding AS last,
    list_transform(embedding, lambda x: x * 2) AS first FROM embeddings),
unnested AS (SELECT vec_id AS linex_index, label, token, -2 AS layer, 0 AS lay, first AS v FROM rec
    UNION ALL SELECT vec_id, label, token, -1, 1, last FROM rec)"""


def records(spark, sf):
    """The embeddings table as nested records (label, linex_index, features)."""
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), F.col("label") + 1)
    last = F.col("embedding").cast("array<double>")
    first = F.transform("embedding", lambda x: (x * F.lit(2).cast("float")).cast("double"))
    layers = F.array(
        F.struct(F.lit(-2).cast("bigint").alias("index"), first.alias("values")),
        F.struct(F.lit(-1).cast("bigint").alias("index"), last.alias("values")),
    )
    features = F.array(F.struct(word.alias("token"), layers.alias("layers")))
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("file_id"), F.col("vec_id").alias("linex_index"), features.alias("features")
    )


def _total(name: str = "values"):
    return F.round(F.aggregate(name, F.lit(0.0), lambda a, x: a + F.round(x.cast("double"), 6)), 4).alias("total")


_SQL_TOTAL = "round(list_sum(list_transform(v, lambda x: round(CAST(x AS DOUBLE), 6))), 4) AS total"


def stored_records(spark, sf):
    path = fresh_path(spark, "records")
    writers.write_embeddings(records(spark, sf), path)
    return readers.read_embeddings(spark, path)


@query("s1_embedding_scan", f"WITH {SQL_RECORDS} SELECT linex_index, token, CAST(layer AS BIGINT) AS layer, {_SQL_TOTAL} FROM unnested")
def s1(spark, sf):
    rows = R.unnest(stored_records(spark, sf), ())
    return rows.select(F.shiftright("vec_id", 32).alias("linex_index"), "token", "layer", _total())


@query("s6_embedding_sink", f"WITH {SQL_RECORDS} SELECT linex_index, CAST(len(v) AS INTEGER) AS n, round(CAST(v[1] AS DOUBLE), 6) AS first FROM unnested WHERE layer = -1")
def s6(spark, sf):
    last = F.element_at(F.element_at("features", 1)["layers"], -1)["values"]
    return stored_records(spark, sf).select("linex_index", F.size(last).alias("n"), F.element_at(last, 1).alias("first"))


@query("s2_json_rows", f"WITH {SQL_RECORDS} SELECT linex_index, token, CAST(2 AS INTEGER) AS n_layers, {_SQL_TOTAL} FROM unnested WHERE layer = -1")
def s2(spark, sf):
    text = records(spark, sf).select("linex_index", F.to_json(F.struct("features")).alias("json"))
    back = text.select("linex_index", F.from_json("json", R.RECORD_SCHEMA)["features"].alias("features"))
    rows = back.select("linex_index", F.inline("features"))
    return rows.select(
        "linex_index", "token", F.size("layers").alias("n_layers"), F.element_at("layers", -1)["values"].alias("values")
    ).select("linex_index", "token", "n_layers", _total())


@query("p1_column_selection", f"WITH {SQL_RECORDS} SELECT token, count(*) AS n FROM rec GROUP BY token")
def p1(spark, sf):
    tokens = stored_records(spark, sf).select(F.explode("features.token").alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "p3_unnest",
    f"WITH {SQL_RECORDS} SELECT CAST(label AS BIGINT) AS file_id, linex_index * 4294967296 + lay AS vec_id, token, CAST(layer AS BIGINT) AS layer, {_SQL_TOTAL} FROM unnested",
)
def p3(spark, sf):
    return R.unnest(records(spark, sf)).select("file_id", "vec_id", "token", "layer", _total())


_SQL_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("p4_no_stop_words", f"WITH {SQL_RECORDS} SELECT linex_index * 4294967296 + lay AS vec_id, token FROM unnested WHERE token NOT IN ({_SQL_STOP})")
def p4(spark, sf):
    return R.without_tokens(R.unnest(records(spark, sf))).select("vec_id", "token")


@query("p9_pick_layers", f"WITH {SQL_RECORDS} SELECT linex_index, CAST(1 AS INTEGER) AS n, CAST(layer AS BIGINT) AS layer FROM unnested WHERE layer = -1")
def p9(spark, sf):
    picked = records(spark, sf).withColumn("features", R.pick_layers(F.col("features"), [-1]))
    layers = picked.select("linex_index", F.element_at("features", 1)["layers"].alias("layers"))
    return layers.select("linex_index", F.size("layers").alias("n"), F.element_at("layers", 1)["index"].alias("layer"))


@query("r2_json_values", "SELECT doc_id, lang, n_chars FROM documents")
def r2(spark, sf):
    docs = table(spark, sf, "documents")
    json = docs.select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("j"))
    return json.select(F.from_json("j", "doc_id bigint, lang string, n_chars bigint").alias("s")).select("s.*")


@query(
    "r3_nest_outputs",
    "WITH flat AS (SELECT conv_id, role, length(text) AS n FROM conversations) "
    "SELECT conv_id, role AS token, CAST(n AS DOUBLE) AS first FROM flat",
)
def r3(spark, sf):
    turns = table(spark, sf, "conversations")
    zipped = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("token"), F.array(F.length("text").cast("double")).alias("values"))))
    nested = turns.groupBy("conv_id").agg(F.transform(zipped, lambda z: F.struct(
        z["token"].alias("token"),
        F.array(F.struct(F.lit(-1).cast("bigint").alias("index"), z["values"].alias("values"))).alias("layers"),
    )).alias("features"))
    flat = R.unnest(nested.withColumn("linex_index", F.col("conv_id")), ("conv_id",))
    return flat.select("conv_id", "token", F.element_at("values", 1).alias("first"))


@query("r4_gather", "SELECT vec_id, array_to_string(list_transform([embedding[3], embedding[1], embedding[64]], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ' ') AS out FROM embeddings")
def r4(spark, sf):
    gathered = X.gather(F.col("embedding"), F.array(F.lit(2), F.lit(0), F.lit(63)))
    scaled = F.transform(gathered, lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(scaled.cast("array<string>"), " ").alias("out"))


ALL_CELLS = 1 << 30  # probes

# ---- vector expressions ----------------------------------------------------------


@query(
    "m1_dot_product",
    f"WITH {SQL_CELLS} SELECT vec_id, CAST(cell AS INTEGER) AS cell, s AS score FROM cell_scores",
)
def m1(spark, sf):
    # Every vector against every label centre: all cells are probed, centres come by a join.
    centres = written(label_centroids(spark, sf), "centres")
    probed = N.probe_closest(corpus_vectors(spark, sf).select("vec_id", "embedding"), centres, ALL_CELLS)
    both = probed.join(centres, "cell")
    return both.select("vec_id", "cell", F.round(X.dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))


@query(
    "m2_normalise",
    f"WITH {SQL_UNIT} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x))), 4) AS len, round(CAST(e[1] AS DOUBLE), 4) AS first FROM unit",
)
def m2(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", X.normalise(X.to_float32(F.col("embedding"))).alias("e"))
    length = F.sqrt(X.dot(F.col("e"), F.col("e")))
    return rows.select("vec_id", F.round(length, 4).alias("len"), F.round(F.element_at("e", 1).cast("double"), 4).alias("first"))


@query("m3_to_float32", "SELECT vec_id, round(CAST(CAST(CAST(embedding[2] AS DOUBLE) / 3.0 AS FLOAT) AS DOUBLE), 6) AS out FROM embeddings")
def m3(spark, sf):
    thirds = F.transform("embedding", lambda x: x.cast("double") / 3.0)
    out = F.element_at(X.to_float32(thirds), 2).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(out, 6).alias("out"))


@query("m4_round_values", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))), 5) AS total FROM embeddings")
def m4(spark, sf):
    total = F.aggregate(X.round_values(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(total, 5).alias("total"))


# ---- neighbours --------------------------------------------------------------------

PAIR_COLUMNS = ("doc_id", "query_id", "file_id", "vec_id", "score")


@query("j1_pairs_over_threshold", f"WITH {SQL_SCORED} SELECT * FROM scored WHERE score > {THRESHOLD}")
def j1(spark, sf):
    index = demo_index(spark, sf)
    return N.above_threshold(
        query_vectors(spark, sf), index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, THRESHOLD,
        statistics=index.statistics, blocks=index.blocks,
    ).select(*PAIR_COLUMNS)


@query(
    "p7_threshold",
    f"WITH {SQL_CELLS} SELECT vec_id, CAST(cell AS INTEGER) AS cell, s AS score FROM cell_scores WHERE s > 0.4",
)
def p7(spark, sf):
    return m1(spark, sf).filter(F.col("score") > 0.4)


_NEAREST = (
    "nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id ORDER BY score DESC, file_id, vec_id) AS rank FROM {source})"
)
_RANKED = "SELECT doc_id, query_id, file_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= {k}"


@query("j2_nearest_exact", f"WITH {SQL_SCORED}, {_NEAREST.format(source='scored')} {_RANKED.format(k=K)}")
def j2(spark, sf):
    index = demo_index(spark, sf)
    return N.nearest(query_vectors(spark, sf), index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, K, blocks=index.blocks, statistics=index.statistics)


NPROBE = 3
SQL_PROBED = f"""{SQL_CELLS},
probes AS (SELECT vec_id, cell FROM cell_ranks WHERE rn <= {NPROBE}),
probed AS (SELECT q.file_id AS doc_id, q.vec_id AS query_id, c.file_id, c.vec_id,
    round(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])), 6) AS score
    FROM probes p JOIN unit q USING (vec_id) JOIN cells d ON d.cell = p.cell JOIN unit c ON c.vec_id = d.vec_id)"""


@query("j3_nearest_in_cells", f"WITH {SQL_PROBED}, {_NEAREST.format(source='probed')} {_RANKED.format(k=K)}")
def j3(spark, sf):
    index = demo_index(spark, sf)
    return N.nearest(
        query_vectors(spark, sf), index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, K, nprobe=NPROBE, blocks=index.blocks
    )


@query("k3_probed_cells", f"WITH {SQL_CELLS} SELECT vec_id, CAST(cell AS INTEGER) AS cell FROM cell_ranks WHERE rn <= {NPROBE}")
def k3(spark, sf):
    probed = N.probe_closest(query_vectors(spark, sf), label_centroids(spark, sf), NPROBE)
    return probed.select(F.col("query_id").alias("vec_id"), "cell")


@query("k2_assign_cells", f"WITH {SQL_CELLS} SELECT vec_id, cell, s AS cell_score FROM cells")
def k2(spark, sf):
    return N.assign_cells(corpus_vectors(spark, sf), label_centroids(spark, sf)).select("vec_id", "cell", "cell_score")


@query("k1_train_clusters", "SELECT vec_id, 64 AS dim, TRUE AS is_closest, TRUE AS is_as_good FROM embeddings")
def k1(spark, sf):
    # SQL cannot train, but says what must hold: every vector lies in its closest cell, and
    # the cells fit the vectors as well as the labels' own centres do, within 2 %.
    vectors = corpus_vectors(spark, sf).select("vec_id", "embedding")
    centroids = written(N.train_centroids(vectors, seed=7), "centres")
    assigned = written(N.assign_cells(vectors, centroids), "assigned")
    scores = N.probe_closest(vectors, centroids, ALL_CELLS).join(centroids, "cell")
    best = scores.groupBy("vec_id").agg(F.max(F.round(X.dot(F.col("embedding"), F.col("centroid")), 6)).alias("best"))
    labels = N.assign_cells(vectors, written(label_centroids(spark, sf), "labels"))
    cost = lambda rows: rows.agg(F.sum(1 - F.col("cell_score"))).scalar()
    dims = centroids.select("cell", F.size("centroid").alias("dim"))
    return assigned.join(best, "vec_id").join(dims, "cell").select(
        "vec_id", "dim", (F.abs(F.col("cell_score") - F.col("best")) <= 2e-6).alias("is_closest"),
        (cost(assigned) <= cost(labels) * 1.02).alias("is_as_good"),
    )


_ORDER = "row_number() OVER (PARTITION BY doc_id, query_id ORDER BY score DESC, file_id, vec_id)"


@query("w3_rank_neighbours", f"WITH {SQL_SCORED} SELECT doc_id, query_id, vec_id, CAST({_ORDER} AS INTEGER) AS rank FROM scored WHERE score > 0.2")
def w3(spark, sf):
    index = demo_index(spark, sf)
    pairs = N.above_threshold(
        query_vectors(spark, sf), index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, 0.2
    )
    return N.best_k(pairs, M.QUERY_IDS, M.CORPUS_IDS, None).select("doc_id", "query_id", "vec_id", "rank")


def hits(spark, sf, k: int | None = K):
    index = demo_index(spark, sf)
    return N.above_threshold(
        query_vectors(spark, sf), index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, THRESHOLD, k, index.statistics,
        blocks=index.blocks,
    )


@query("o1_top_k", f"WITH {sql_hits()} SELECT doc_id, query_id, file_id, vec_id, score, CAST(rn AS INTEGER) AS rank FROM hits")
def o1(spark, sf):
    return hits(spark, sf).select(*PAIR_COLUMNS, "rank")


# ---- scoring -------------------------------------------------------------------------

_PER_FILE = f"{sql_hits()}, per_file AS (SELECT doc_id, file_id, count(*) AS hits FROM hits GROUP BY ALL), "
_N_QUERY = "n_query AS (SELECT file_id AS doc_id, count(*) AS n_query FROM unit GROUP BY ALL)"
_PERCENT = f"{_PER_FILE}{_N_QUERY}, percents AS (SELECT doc_id, file_id, hits, hits / (n_query * {K}) * 100 AS percent FROM per_file JOIN n_query USING (doc_id))"


@query("a1_hits_per_file", f"WITH {_PER_FILE}x AS (SELECT 1) SELECT * FROM per_file")
def a1(spark, sf):
    return M.hits_per_file(hits(spark, sf))


@query("a2_match_percent", f"WITH {_PERCENT} SELECT * FROM percents")
def a2(spark, sf):
    return indexing.similarity(query_vectors(spark, sf), demo_index(spark, sf), LOW)


@query("c4_similarity_from_index", f"WITH {_PERCENT} SELECT * FROM percents")
def c4(spark, sf):
    index = indexing.build_index(corpus_vectors(spark, sf), fresh_path(spark, "index"))
    return indexing.similarity(query_vectors(spark, sf), index, LOW)


_SQL_BEST = "SELECT doc_id, max(percent) AS max_percent, arg_min(file_id, (-percent, file_id)) AS file_id FROM percents GROUP BY doc_id"


@query("a3_best_file", f"WITH {_PERCENT} {_SQL_BEST}")
def a3(spark, sf):
    return M.best_file(a2(spark, sf))


@query(
    "a4_exceed_percent",
    f"WITH {SQL_SCORED} SELECT doc_id, file_id, sum(CASE WHEN score > {THRESHOLD} THEN 1 ELSE 0 END) / count(*) * 100 AS percent "
    "FROM scored GROUP BY ALL HAVING percent > 0",
)
def a4(spark, sf):
    rows, index = corpus_vectors(spark, sf), demo_index(spark, sf)
    queries = query_vectors(spark, sf)
    counted = N.count_above_threshold(
        queries, index.vectors, index.centroids, M.QUERY_IDS, "file_id", THRESHOLD, index.statistics,
        blocks=index.blocks,
    )
    return M.exceed_percent(counted, M.vectors_per_document(queries), M.vectors_per_file(rows))


@query("a5_vectors_per_file", "SELECT CAST(label AS BIGINT) AS file_id, count(*) AS n_vectors FROM embeddings GROUP BY label")
def a5(spark, sf):
    return M.vectors_per_file(corpus_vectors(spark, sf))


@query("a6_number_of_files", "SELECT count(DISTINCT label) AS n_files FROM embeddings")
def a6(spark, sf):
    return M.number_of_files(corpus_vectors(spark, sf))


@query("a7_adaptive_k", "SELECT CAST(10 / 100.0 * 1000 * count(DISTINCT label) AS BIGINT) AS k FROM embeddings")
def a7(spark, sf):
    return M.adaptive_k(M.number_of_files(corpus_vectors(spark, sf)))


_VERDICT = f"""{_PERCENT}, best AS ({_SQL_BEST})
SELECT d.doc_id, coalesce(max_percent, CASE WHEN n_query IS NULL THEN CAST('NaN' AS DOUBLE) ELSE 0 END) AS max_similarity_percentage,
CASE WHEN n_query IS NULL THEN 'Error in checking: file format not supported' WHEN coalesce(max_percent, 0) >= 10 THEN 'True' ELSE 'False' END AS plagiarism_status,
file_id FROM documents d LEFT JOIN n_query USING (doc_id) LEFT JOIN best USING (doc_id)"""


@query("s13_verdicts", f"WITH {_VERDICT}")
def s13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    queries = query_vectors(spark, sf)
    return M.verdicts(docs, M.vectors_per_document(queries), a2(spark, sf))


@query(
    "p10_verdict",
    "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'Error in checking: file format not supported' WHEN n_chars / 100.0 >= 10 THEN 'True' ELSE 'False' END AS status FROM documents",
)
def p10(spark, sf):
    percent = F.when(F.col("n_chars") < 100, F.lit(float("nan"))).otherwise(F.col("n_chars") / 100.0)
    return table(spark, sf, "documents").select("doc_id", M.verdict(percent).alias("status"))


@query("j4a_file_by_id", f"WITH {sql_hits()} SELECT doc_id, file_id, count(*) AS hits FROM hits GROUP BY ALL")
def j4a(spark, sf):
    # Vectors are numbered anew in each file, as record files do, so numbers repeat.
    vectors = corpus_vectors(spark, sf)
    numbers = G.running_total(
        vectors.drop("embedding"), G.integer_levels(F.col("vec_id")), ["vec_id"], F.lit(1), "number", within=["file_id"]
    ).select("file_id", "vec_id", "number")
    corpus = vectors.join(numbers, ["file_id", "vec_id"]).withColumn("vec_id", F.col("number")).drop("number")
    index = indexing.build_index(corpus, fresh_path(spark, "index"), centroids=label_centroids(spark, sf))
    found = N.above_threshold(
        query_vectors(spark, sf), index.vectors, index.centroids, M.QUERY_IDS, M.CORPUS_IDS, THRESHOLD, K, index.statistics
    )
    files = corpus.select("file_id", "vec_id", F.concat(F.lit("file-"), "file_id").alias("file"))
    named = M.attribute_by_id(found, files)
    per_file = named.withColumn("file_id", F.regexp_extract("file", "[0-9]+", 0).cast("bigint"))
    return M.hits_per_file(per_file, F.col("n"))


@query(
    "j4b_file_by_offsets",
    f"WITH {sql_hits()}, pos AS (SELECT vec_id, file_id, row_number() OVER (ORDER BY file_id, vec_id) - 1 AS position FROM unit) "
    "SELECT doc_id, p.position, p.file_id, count(*) AS hits FROM hits JOIN pos p USING (vec_id) GROUP BY ALL",
)
def j4b(spark, sf):
    vectors = corpus_vectors(spark, sf)
    offsets = G.file_offsets(M.vectors_per_file(vectors))
    # Positions as the older index gave them: files in a row, vectors in id order.
    placed = G.running_total(
        vectors.select("file_id", "vec_id"),
        [*G.integer_levels(F.col("file_id")), F.col("file_id"), F.shiftright("vec_id", 16)],
        ["vec_id"], F.lit(1), "position",
    ).select("vec_id", (F.col("position") - 1).alias("position"))
    found = hits(spark, sf).groupBy("doc_id", "vec_id").agg(F.count("*").alias("hits"))
    rows = found.join(placed, "vec_id").select("doc_id", "position", "hits")
    return M.attribute_by_offsets(rows, offsets).select("doc_id", "position", "file_id", "hits")


@query(
    "w1_file_offsets",
    "WITH n AS (SELECT doc_id AS file_id, n_chars AS n_vectors FROM documents) "
    "SELECT file_id, CAST(sum(n_vectors) OVER (ORDER BY file_id) - n_vectors AS BIGINT) AS start_off, CAST(sum(n_vectors) OVER (ORDER BY file_id) AS BIGINT) AS end_off FROM n",
)
def w1(spark, sf):
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("n_vectors"))
    return G.file_offsets(sizes)


# ---- the index ---------------------------------------------------------------------------


@query("s7_index_sink", f"WITH {SQL_CELLS} SELECT vec_id, file_id, cell, s AS cell_score FROM cells")
def s7(spark, sf):
    return demo_index(spark, sf).vectors.select("vec_id", "file_id", "cell", "cell_score")


@query("s8_index_load", f"WITH {SQL_CELLS} SELECT cell, count(*) AS n_vectors, min(s) AS min_score FROM cells GROUP BY cell")
def s8(spark, sf):
    return demo_index(spark, sf).statistics


@query("u1_append_vectors", f"WITH {SQL_UNIT} SELECT file_id, count(*) * 2 AS n FROM unit GROUP BY file_id")
def u1(spark, sf):
    rows = corpus_vectors(spark, sf).select("file_id", "vec_id", "embedding")
    return rows.unionByName(rows).groupBy("file_id").agg(F.count("*").alias("n"))


@query(
    "c3_similarity_to_corpus",
    f"WITH {sql_hits(1000)}, per_file AS (SELECT doc_id, file_id, count(*) AS hits FROM hits GROUP BY ALL), {_N_QUERY} "
    "SELECT doc_id, file_id, hits, hits / (n_query * 1000) * 100 AS percent FROM per_file JOIN n_query USING (doc_id)",
)
def c3(spark, sf):
    raw = table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    queries = raw.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("query_id"), "embedding")
    corpus = raw.select(F.col("label").alias("file_id"), "vec_id", F.lit("").alias("token"), "embedding")
    return indexing.similarity_to_corpus(queries, corpus, LOW)


@query(
    "c7_build_index",
    f"WITH {SQL_RECORDS}, {SQL_CELLS} SELECT linex_index * 4294967296 + lay AS vec_id, token, c.cell "
    f"FROM unnested u JOIN cells c ON c.vec_id = u.linex_index WHERE token NOT IN ({_SQL_STOP})",
)
def c7(spark, sf):
    # Both layers of a record have the same direction, so both lie in its vector's cell.
    path = fresh_path(spark, "records")
    writers.write_embeddings(records(spark, sf), path)
    index = indexing.build_index_from_records(
        spark, path, fresh_path(spark, "index"), centroids=label_centroids(spark, sf)
    )
    return index.vectors.select("vec_id", "token", "cell")


# ---- checks of whole documents ----------------------------------------------------------------

# Token vectors of the stand-in model do not depend on the context, so SQL can score tokens
# once and count their occurrences.
CHECK = replace(DEFAULTS, min_space=26)
CHECK_K = DEFAULTS.neighbours


def _sql_check(pieces: str) -> str:
    return f"""WITH RECURSIVE {pieces}, {SQL_VOCAB}, {sql_occurrences('sentences', 'doc_id, pos', 'sentence', 'occ')},
{sql_pieces('occ', 'wp')},
sent AS (SELECT doc_id, pos, flatten(list(pieces ORDER BY tok)) AS t FROM occ JOIN wp USING (word) GROUP BY ALL),
framed AS (SELECT doc_id, pos, flatten([['[CLS]'], t[1:126], ['[SEP]']]) AS t FROM sent),
placed AS (SELECT doc_id, pos, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS tok FROM framed),
vecs AS (SELECT doc_id, pos * 4294967296 + tok * 4096 AS vec_id, token FROM placed WHERE token NOT IN ({_SQL_STOP})),
model AS (SELECT id, token, list_transform(range(0, 16), lambda j: CAST(
    ((id * 7919 + j * j * 104729 + (id % 97) * (j + 1) * 15485863) % 10007) / CAST(5003.5 AS DOUBLE) - 1.0 AS FLOAT)) AS v
    FROM (SELECT CAST(id AS BIGINT) AS id, token FROM vocab WHERE token IN (SELECT token FROM vecs))),
lens AS (SELECT token, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM model),
dirs AS (SELECT token, list_transform(v, lambda x: CAST(x / n AS FLOAT)) AS e FROM lens),
near AS (SELECT a.token AS qt, b.token AS ct, round(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])), 6) AS score
    FROM dirs a, dirs b WHERE score > 0.9),
slots AS (SELECT qt, file_id, vec_id, row_number() OVER (PARTITION BY qt ORDER BY score DESC, file_id, vec_id) AS rn
    FROM near JOIN (SELECT doc_id AS file_id, vec_id, token FROM vecs) c ON c.token = ct),
per_token AS (SELECT qt, file_id, count(*) AS n FROM slots WHERE rn <= {CHECK_K} GROUP BY ALL),
doc_tokens AS (SELECT doc_id, token, count(*) AS n FROM vecs GROUP BY ALL),
n_query AS (SELECT doc_id, sum(n) AS n_query FROM doc_tokens GROUP BY doc_id),
per_file AS (SELECT doc_id, file_id, sum(d.n * p.n) AS hits FROM doc_tokens d JOIN per_token p ON p.qt = d.token GROUP BY ALL),
percents AS (SELECT doc_id, file_id, hits / (n_query * {CHECK_K}) * 100 AS percent FROM per_file JOIN n_query USING (doc_id)),
best AS ({_SQL_BEST})
SELECT d.doc_id, coalesce(max_percent, CASE WHEN n_query IS NULL THEN CAST('NaN' AS DOUBLE) ELSE 0 END) AS max_similarity_percentage,
CASE WHEN n_query IS NULL THEN 'Error in checking: file format not supported' WHEN coalesce(max_percent, 0) >= 10 THEN 'True' ELSE 'False' END AS plagiarism_status,
file_id FROM documents d LEFT JOIN n_query USING (doc_id) LEFT JOIN best USING (doc_id)"""


def document_index(spark, sf, pieces, vocab):
    """The documents table as a corpus: every document is a file."""
    vectors = checking.text_vectors(pieces, vocab, hashed_token_model(16), CHECK)
    corpus = written(vectors.withColumnRenamed("doc_id", "file_id"), "corpus")
    return indexing.build_index(corpus, fresh_path(spark, "index"), CHECK)


@query("c5_check_documents", _sql_check(sql_sentences()))
def c5(spark, sf):
    from ..operators.sentences import sentences

    docs, vocab = table(spark, sf, "documents"), demo_vocabulary(spark, sf)
    index = document_index(spark, sf, sentences(docs, CHECK), vocab)
    return checking.check_documents(docs, index, vocab, hashed_token_model(16), CHECK)


def _c6_sql() -> str:
    from .texts import _BODY, PARAGRAPHS

    return _sql_check(f"{_BODY}, {PARAGRAPHS.format(source='cut')}, sentences AS (SELECT * FROM paragraphs)")


@query("c6_check_paragraphs", _c6_sql())
def c6(spark, sf):
    from ..operators.sentences import paragraphs
    from .texts import BORDERS, CHAPTERS, SEPARATORS

    options = replace(CHECK, chapters=CHAPTERS, max_chapter_pieces=40)
    cuts = {"borders": BORDERS, "separators": SEPARATORS, "chapter_word": "is"}
    docs, vocab = table(spark, sf, "documents"), demo_vocabulary(spark, sf)
    index = document_index(spark, sf, paragraphs(docs, options, **cuts), vocab)
    return checking.check_paragraphs(docs, index, vocab, hashed_token_model(16), options, **cuts)


# ---- streams ------------------------------------------------------------------------------------


@query("st1_check_stream", _sql_check(sql_sentences()))
def st1(spark, sf):
    from ..operators.sentences import sentences

    docs, vocab = table(spark, sf, "documents").select("doc_id", "text"), demo_vocabulary(spark, sf)
    index = document_index(spark, sf, sentences(docs, CHECK), vocab)
    incoming, out = fresh_path(spark, "incoming"), fresh_path(spark, "verdicts")
    docs.repartition(2, "doc_id").write.parquet(incoming)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(incoming)  # two micro-batches
    run = check_stream(stream, index, vocab, hashed_token_model(16), out, fresh_path(spark, "stream"), CHECK)
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query("st1_score_stream", f"WITH {_PERCENT} SELECT * FROM percents")
def st1_scores(spark, sf):
    incoming, out = fresh_path(spark, "incoming"), fresh_path(spark, "scores")
    queries = query_vectors(spark, sf)
    queries.repartition(3, "query_id").write.parquet(incoming)  # documents span files and micro-batches
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    run = score_stream(stream, demo_index(spark, sf), out, fresh_path(spark, "stream"), LOW)
    run.awaitTermination()
    return read_scores(spark, out, K)


@query("st2_extend_index", f"WITH {SQL_CELLS} SELECT vec_id, file_id, cell, s AS cell_score FROM cells")
def st2(spark, sf):
    incoming, path = fresh_path(spark, "incoming"), fresh_path(spark, "index")
    vectors = corpus_vectors(spark, sf)
    vectors.write.parquet(incoming)
    centroids = label_centroids(spark, sf)
    writers.write_index(vectors.filter(F.lit(False)), centroids, path)
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 3).parquet(incoming)
    run = extend_index(stream, centroids, path, fresh_path(spark, "stream"), "first")
    run.awaitTermination()
    return readers.read_index(spark, path).vectors.select("vec_id", "file_id", "cell", "cell_score")
