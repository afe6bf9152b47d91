"""Sinks: record files, clean texts, the vector index, training records, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.neighbours import assign_cells, block_heads, cell_statistics, cut_to_blocks
from ..operators.records import rounded_records
from ..operators.sentences import clean_texts, not_done, sentences
from ..options import DEFAULTS, Options
from ..session import written

ROWS_PER_FILE = 250_000  # of a file, and of a block of near vectors
# The last two are folders.
VECTOR_SCHEMA = (
    "file_id bigint, vec_id bigint, token string, embedding array<float>, cell_score double, block int, block_score double, "
    "batch string, cell int"
)

STATISTICS_SCHEMA = "cell int, n_vectors bigint, min_score double, batch string"
BLOCK_SCHEMA = "cell int, block int, n_vectors bigint, min_score double, centre array<float>, batch string"


def write_embeddings(records: DataFrame, path: str) -> None:
    """One JSON object per sentence and line, values rounded to 6 digits."""
    rounded_records(records).select("linex_index", "features").write.json(path)


def write_clean_texts(docs: DataFrame, path: str, options: Options = DEFAULTS) -> None:
    """Clean texts (doc_id, text), appended for the documents not stored yet.

    A document without a sentence is stored with an empty text, so it is done, too.
    """
    todo = docs.select("doc_id", "text")
    if exists(docs.sparkSession, path):
        todo = not_done(todo, docs.sparkSession.read.parquet(path))
    texts = clean_texts(sentences(todo, options)).withColumnRenamed("text", "_clean")
    whole = todo.select("doc_id").distinct().join(texts, "doc_id", "left")
    whole.select("doc_id", F.coalesce("_clean", F.lit("")).alias("text")).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_corpus(pieces: DataFrame, path: str) -> None:
    """Append documents to a training corpus, a blank line after each."""
    clean_texts(pieces).select(F.concat("text", F.lit("\n"))).write.mode("append").text(path)


def write_index(vectors: DataFrame, centroids: DataFrame, path: str, block_rows: int = ROWS_PER_FILE) -> None:
    """Store vectors by cell, with the centres, the cell statistics and the heads of blocks."""
    centroids.write.parquet(f"{path}/centroids")
    write_vectors(vectors, centroids, path, "build", block_rows)


def write_vectors(vectors: DataFrame, centroids: DataFrame, path: str, batch: str, block_rows: int = ROWS_PER_FILE) -> None:
    """Assign vectors to cells and blocks and store them as one batch of the index, with its statistics."""
    store_vectors(written(assign_cells(vectors, centroids), "assigned"), centroids, path, batch, block_rows)


def store_vectors(assigned: DataFrame, centroids: DataFrame, path: str, batch: str, block_rows: int = ROWS_PER_FILE) -> None:
    """Store vectors that know their cell (a written table) as one batch of the index.

    A cell's rows go to as many writers as its count asks for, a block to one of them, so a
    crowded cell becomes several files and a small one a single file, sorted by block.
    Writing a batch again replaces it.
    """
    cut, centres = cut_to_blocks(assigned, centroids, block_rows)
    sizes = assigned.groupBy("cell").agg(F.ceil(F.count("*") / ROWS_PER_FILE).cast("int").alias("_files"))
    sized = cut.join(sizes, "cell")
    spread = F.pmod(F.xxhash64("block"), F.col("_files")).cast("int")
    rows = sized.withColumn("_file", spread).repartition("cell", "_file").sortWithinPartitions("cell", "block")
    stored = f"{path}/vectors/batch={batch}"
    rows.drop("_files", "_file").write.mode("overwrite").partitionBy("cell").parquet(stored)
    spark = assigned.sparkSession
    kept = spark.read.schema(VECTOR_SCHEMA).option("basePath", f"{path}/vectors").parquet(stored)
    cell_statistics(kept).write.mode("overwrite").parquet(f"{path}/statistics/batch={batch}")
    block_heads(kept, centres).write.mode("overwrite").parquet(f"{path}/blocks/batch={batch}")


def write_records(records: DataFrame, path: str) -> None:
    """Training records, one folder per shard; within a file in shuffled order, if they have a ``position``."""
    if "position" in records.columns:
        records = records.sortWithinPartitions("shard", "position")
    records.write.partitionBy("shard").parquet(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    """Metric lines as one small text file."""
    lines.coalesce(1).write.text(path)
