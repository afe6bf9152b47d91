"""Build the corpus index and score query vectors against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import normalise, to_float32
from ..operators import matching as M, neighbours as N, records as R
from ..operators.skew import lookup_join
from ..options import DEFAULTS, Options
from ..session import fresh_path, written
from ..sources.readers import Index, file_id, read_embeddings, read_index
from ..sources.writers import write_index


def build_index(
    vectors: DataFrame, path: str, options: Options = DEFAULTS, centroids: DataFrame | None = None
) -> Index:
    """Cluster corpus vectors (file_id, vec_id, token, embedding) and store them."""
    if centroids is None:
        centroids = N.train_centroids(vectors, options.clusters, options.seed)
    write_index(vectors, centroids, path)
    return read_index(vectors.sparkSession, path)


def build_index_from_records(
    spark: SparkSession, records_path: str, index_path: str, options: Options = DEFAULTS, multi_line: bool = False,
    centroids: DataFrame | None = None,
) -> Index:
    """Embedding record files to a stored index; nothing is collected."""
    records = read_embeddings(spark, records_path, multi_line).withColumn("file_id", file_id())
    return build_index(R.token_vectors(records), index_path, options, centroids)


def similarity(
    queries: DataFrame,
    index: Index,
    options: Options = DEFAULTS,
    nprobe: int | None = None,
    k: int | None = None,
) -> DataFrame:
    """Percent of each document's neighbour slots that hit each file (doc_id, file_id, hits, percent).

    ``queries`` has doc_id, query_id and a unit-length embedding. Equal vectors have the
    same neighbours, so each distinct vector is searched once and its hits per file are
    counted for every copy; a vector that fills a third of the input costs one search.
    The threshold is applied before the best k are ranked: same rows, far fewer to rank.
    """
    k = options.neighbours if k is None else k
    # Equal vectors are grouped by value; the smallest row that carries one names it.
    row = F.struct("doc_id", F.min("query_id").alias("query_id")).alias("_row")
    per_document = written(queries.groupBy("embedding", "doc_id").agg(F.count("*").alias("_copies"), row), "query-vectors")
    named = per_document.groupBy("embedding").agg(F.min("_row").alias("_name"), F.count("*").alias("n"))
    named = named.withColumn("_number", F.monotonically_increasing_id())
    named = written(named.select("embedding", F.col("_name.doc_id").alias("named_doc"), F.col("_name.query_id").alias("named_query"), "n", "_number"), "vectors")
    name = ["named_doc", "named_query"]
    hits, n_hits = N.numbered_hits_by_value(
        named, index.vectors, index.centroids, name, M.CORPUS_IDS, "file_id", options.threshold, k, index.statistics, nprobe,
        blocks=index.blocks,
    )
    found = hits.withColumnRenamed("n", "_hits").join(named.select(*name, "_number"), name)
    # A vector found in most documents is spread over several tasks.
    own = lookup_join(per_document, named.select("embedding", "_number"), "embedding", named, F.col("doc_id"), "inner")
    per_file = N.block_sums(
        own, found, "_number", ("doc_id", "file_id"), ("_copies", "_hits"), (per_document.count(), n_hits)
    ).withColumnRenamed("n", "hits")
    n_query = written(M.vectors_per_document(queries), "vectors-per-document")  # Spark knows its size
    return M.match_percent(per_file, n_query, k)


def similarity_to_corpus(
    queries: DataFrame, corpus: DataFrame, options: Options = DEFAULTS, nprobe: int | None = None
) -> DataFrame:
    """Score against a corpus without a stored index.

    Both sides are normalised, the index is built in the shared folder, and k grows with
    the number of files.
    """
    def unit(df: DataFrame) -> DataFrame:
        return df.withColumn("embedding", normalise(to_float32(F.col("embedding"))))

    spark = corpus.sparkSession
    index = build_index(unit(corpus), fresh_path(spark, "index"), options)
    files = M.number_of_files(index.vectors)
    k = M.adaptive_k(files, options.verdict_percent, options.words_per_file).first()["k"]
    return similarity(unit(queries), index, options, nprobe, k)
