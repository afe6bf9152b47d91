"""Readers of texts, vocabularies, embedding records, indexes and training records."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import trimmed
from ..operators.positions import document_numbers, hash_levels, running_total
from ..operators.neighbours import merged_statistics
from ..operators.records import RECORD_SCHEMA
from .writers import BLOCK_SCHEMA, STATISTICS_SCHEMA, VECTOR_SCHEMA


def file_id(path: str = "file"):
    """A file's key: a hash of its path."""
    return F.xxhash64(path)


def read_embeddings(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Embedding records of a folder tree (file, linex_index, features).

    One object per line by default; ``multi_line`` reads one object per file. A line that
    is no such object is an error.
    """
    reader = spark.read.schema(RECORD_SCHEMA).option("recursiveFileLookup", True).option("mode", "FAILFAST").option("multiLine", multi_line)
    return reader.json(path).select(F.col("_metadata.file_path").alias("file"), "linex_index", "features")


def read_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One text file per document (file, doc_id, text)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", file_id().alias("doc_id"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, patterns: str) -> DataFrame:
    """Lines of all files of comma-separated globs (file, block, line_no, line).

    Big files are read in splits, in parallel; ``line_no`` orders the lines of a split.
    """
    lines = spark.read.text([p.strip() for p in patterns.split(",")])
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def read_training_corpus(spark: SparkSession, patterns: str) -> DataFrame:
    """Sentences of a corpus file: one a line, a blank line after each document.

    Returns (file, doc_no, doc_id, block, line_no, line).
    """
    numbered = document_numbers(read_lines(spark, patterns))
    # Documents are numbered through all files, so no two share an id.
    files = numbered.groupBy("file").agg((F.max("doc_no") + 1).alias("_n")).withColumn("_digest", F.md5("file"))
    ends = running_total(files, hash_levels(F.col("_digest")), ["_digest", "file"], F.col("_n"), "_end")
    first = ends.select("file", (F.col("_end") - F.col("_n")).alias("_first"))
    return numbered.join(first, "file").withColumns(
        {"line": trimmed(F.col("line")), "doc_id": F.col("_first") + F.col("doc_no")}
    ).drop("_first")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file: the id is the line number, the last of equal lines wins."""
    lines = F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n"))
    rows = spark.read.text(path, wholetext=True).select(lines.alias("id", "line"))
    token = trimmed(F.col("line"))
    return rows.groupBy(token.alias("token")).agg(F.max("id").alias("id"))


@dataclass(frozen=True)
class Index:
    """A stored corpus: vectors by cell, cell centres, cell statistics and the heads of blocks."""

    vectors: DataFrame
    centroids: DataFrame
    statistics: DataFrame
    blocks: DataFrame


def newest_manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; an index without one is whole as it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    versions = [int(n.removeprefix("version-")) for n in names if n.startswith("version-")]
    if not versions:
        return 0, {"centroids": "centroids", "replaced": [], "split": []}
    (row,) = spark.read.text(f"{path}/manifest/version-{max(versions)}", wholetext=True).collect()
    return max(versions), json.loads(row["value"])


def current(rows: DataFrame, manifest: dict) -> DataFrame:
    """Rows (with batch and cell) that no later batch replaces; filters on folders alone."""
    kept = ~F.col("batch").isin(manifest["replaced"])
    for step in manifest["split"]:  # one per compaction
        kept &= ~(F.col("cell").isin(step["cells"]) & F.col("batch").isin(step["batches"]))
    return rows.filter(kept)


def read_index(spark: SparkSession, path: str) -> Index:
    """Open a stored index as its newest manifest describes it. A search reads the folders of the cells it probes.

    The centre of a cell that was split stays for writers that still know it; a reader
    sees it only if such a writer has added vectors to it.
    """
    _, manifest = newest_manifest(spark, path)
    read = lambda kind, schema: current(spark.read.schema(schema).parquet(f"{path}/{kind}"), manifest)
    statistics = merged_statistics(read("statistics", STATISTICS_SCHEMA))
    centroids = spark.read.parquet(f"{path}/{manifest['centroids']}")
    if manifest["split"]:
        held = statistics.select("cell", F.lit(True).alias("_held"))
        centroids = centroids.join(held, "cell", "left").filter(~F.col("retired") | F.col("_held")).select("cell", "centroid")
    return Index(read("vectors", VECTOR_SCHEMA), centroids, statistics, read("blocks", BLOCK_SCHEMA))


def read_records(
    spark: SparkSession, path: str, max_seq_length: int, max_predictions: int
) -> DataFrame:
    """Training records; a wrong array length is an error, integers become 32 bit."""
    rows = spark.read.parquet(path)
    lengths = {
        "input_ids": max_seq_length,
        "input_mask": max_seq_length,
        "segment_ids": max_seq_length,
        "masked_lm_positions": max_predictions,
        "masked_lm_ids": max_predictions,
        "masked_lm_weights": max_predictions,
        "next_sentence_labels": 1,
    }

    def checked(name: str, n: int):
        kind = "array<float>" if name == "masked_lm_weights" else "array<int>"
        wrong = F.raise_error(F.lit(f"{name} must have {n} values"))
        return F.when(F.size(name) == n, F.col(name)).otherwise(wrong).cast(kind).alias(name)

    kept = [c for c in rows.columns if c not in lengths]
    return rows.select(*kept, *[checked(c, n) for c, n in lengths.items()])


def epochs(records: DataFrame, n: int) -> DataFrame:
    """Repeat records once per epoch."""
    return records.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

