"""From raw documents to a mixed training corpus, in five stages.

Each stage reads what the one before it kept, as Parquet. Mixing is last and reports what
the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textmatch.llm import contain, mixing, secret_tags, simhash, toxicity
from textmatch.session import written

# Shingles of four words, links at four or fewer differing bits: those of the SimHash query.
NEAR = {"n": 4, "max_bits": 4}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links between fingerprints connect."""
    return simhash.keep_first(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return contain.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secret_tags.redact(docs, secret_tags.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    documents, _ = mixing.mix(docs)
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
]

#: Classifiers and fingerprints have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
