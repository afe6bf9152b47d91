"""From neighbour pairs to match percentages and verdicts per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..options import DEFAULTS
from .skew import lookup_join, salts

# Fixed value: the text of a verdict that could not be reached.
UNREADABLE = "Error in checking: file format not supported"


def attribute_by_id(hits: DataFrame, vector_files: DataFrame, keys: Sequence[str] = ("file_id", "vec_id")) -> DataFrame:
    """Add what ``vector_files`` says of each hit vector, one row per document and vector (n).

    ``keys`` name a vector: its number alone repeats from file to file. A vector that most
    documents hit is spread over several tasks.
    """
    counted = hits.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).withColumn("_vector", F.struct(*keys))
    others = [c for c in vector_files.columns if c not in keys]
    files = vector_files.select(F.struct(*keys).alias("_vector"), *others)
    per_vector = counted.groupBy("_vector").agg(F.count("*").alias("n"))
    return lookup_join(counted, files, "_vector", per_vector, F.col("doc_id"), "inner").drop("_vector")


def attribute_by_offsets(hits: DataFrame, offsets: DataFrame, position: str = "position") -> DataFrame:
    """Add the file whose range [start_off, end_off) holds the position.

    A range join as an equi-join: ranges are cut at the borders of bins as wide as the
    average file, so a bin meets few files and a file few bins. A bin with more than its
    share of hits is salted by its count.
    """
    width = F.ceil(F.greatest(offsets.agg(F.max("end_off") / F.count("*")).scalar(), F.lit(1.0)))
    sized = offsets.filter(F.col("end_off") > F.col("start_off")).withColumn("_width", width)
    first, last = F.floor(F.col("start_off") / F.col("_width")), F.floor((F.col("end_off") - 1) / F.col("_width"))
    cut = sized.withColumn("_bin", F.explode(F.sequence(first, last))).drop("_width")
    binned = hits.withColumn("_bin", F.floor(F.col(position) / width))
    heavy = F.broadcast(salts(binned.groupBy("_bin").agg(F.count("*").alias("n")), "_bin"))
    parts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = binned.join(heavy, "_bin", "left").withColumn("_salt", F.pmod(F.xxhash64(*hits.columns), parts).cast("int"))
    cut = cut.join(heavy, "_bin", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    inside = (F.col(position) >= F.col("start_off")) & (F.col(position) < F.col("end_off"))
    joined = salted.drop("_salts").join(cut.drop("_salts"), ["_bin", "_salt"])
    return joined.filter(inside).drop("_bin", "_salt", "start_off", "end_off")


def hits_per_file(hits: DataFrame, weight: Column | None = None) -> DataFrame:
    """Number of hits of each document in each file (doc_id, file_id, hits)."""
    n = F.count("*") if weight is None else F.sum(weight)
    return hits.groupBy("doc_id", "file_id").agg(n.cast("bigint").alias("hits"))


def vectors_per_document(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Query vectors of each document, those without a hit included."""
    return vectors.groupBy(key).agg(F.count("*").alias("n_query"))


def vectors_per_file(vectors: DataFrame, key: str = "file_id") -> DataFrame:
    return vectors.groupBy(key).agg(F.count("*").alias("n_vectors"))


def number_of_files(vectors: DataFrame) -> DataFrame:
    """Files in the corpus, as one row; distinct per task before the shuffle."""
    return vectors.select("file_id").distinct().agg(F.count("*").alias("n_files"))


def adaptive_k(files: DataFrame, percent: float = DEFAULTS.verdict_percent, words_per_file: int = DEFAULTS.words_per_file) -> DataFrame:
    """Neighbours to ask for, growing with the corpus (k)."""
    k = F.lit(percent / 100) * words_per_file * F.col("n_files")
    return files.select(k.cast("bigint").alias("k"))


def match_percent(per_file: DataFrame, n_query: DataFrame, k: int | Column) -> DataFrame:
    """Hits as a percentage of all neighbours asked for (doc_id, file_id, percent)."""
    asked = F.col("n_query") * (F.lit(k) if isinstance(k, int) else k)
    return per_file.join(n_query, "doc_id").withColumn("percent", F.col("hits") / asked * 100).drop("n_query")


def exceed_percent(hits: DataFrame, n_query: DataFrame, n_vectors: DataFrame) -> DataFrame:
    """Share of all pairs of a document and a file that pass the threshold.

    The number of all pairs is a product of two counts. ``hits`` has ``n``, the pairs
    counted where they were scored.
    """
    pairs = F.col("n_query") * F.col("n_vectors")
    counted = hits_per_file(hits, F.col("n")).join(n_query, "doc_id").join(n_vectors, "file_id")
    return counted.select("doc_id", "file_id", (F.col("hits") / pairs * 100).alias("percent"))


def best_file(percents: DataFrame) -> DataFrame:
    """Highest percentage of each document and the file it is for (lowest id on a tie)."""
    best = F.max(F.struct("percent", (-F.col("file_id")).alias("_neg"))).alias("_b")
    return percents.groupBy("doc_id").agg(best).select(
        "doc_id", F.col("_b.percent").alias("max_percent"), (-F.col("_b._neg")).alias("file_id")
    )


def verdict(percent: Column, limit: float = DEFAULTS.verdict_percent) -> Column:
    """Status text for a percentage; NaN means that nothing could be read."""
    return F.when(F.isnan(percent), UNREADABLE).when(percent >= limit, "True").otherwise("False")


def verdicts(
    docs: DataFrame, n_query: DataFrame, percents: DataFrame, limit: float = DEFAULTS.verdict_percent
) -> DataFrame:
    """One verdict per document: 0 without a hit, an error without any vector."""
    best = best_file(percents).withColumnRenamed("max_percent", "_percent")
    joined = docs.select("doc_id").join(n_query, "doc_id", "left").join(best, "doc_id", "left")
    none = F.when(F.col("n_query").isNull(), F.lit(float("nan"))).otherwise(F.lit(0.0))
    percent = F.coalesce("_percent", none)
    return joined.select(
        "doc_id",
        percent.alias("max_similarity_percentage"),
        verdict(percent, limit).alias("plagiarism_status"),
        "file_id",
    )


QUERY_IDS: Sequence[str] = ("doc_id", "query_id")
CORPUS_IDS: Sequence[str] = ("file_id", "vec_id")
