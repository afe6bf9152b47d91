"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def salts(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys with more than their task's share of all rows, and in how many parts to cut them.

    The line is one share of the shuffle partitions, so at most that many keys pass it
    and each part of a key is about one share.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = counts.agg(F.sum(n)).scalar() / F.lit(partitions)
    return counts.filter(F.col(n) > share).select(key, F.ceil(F.col(n) / share).cast("int").alias("_salts"))


def lookup_join(
    left: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, spread: Column, how: str = "left"
) -> DataFrame:
    """Join rows to a table unique in ``key``, spreading the heavy keys.

    Rows of a heavy key get one of its salts from ``spread`` and the lookup row
    is copied to each salt. ``counts`` has the rows per key of ``left``. Adaptive
    execution still turns this into a broadcast join when ``lookup`` measures small.
    """
    heavy = F.broadcast(salts(counts, key))  # a row per shuffle partition at most
    parts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = (
        left.join(heavy, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
        .drop("_salts")
    )
    copied = (
        lookup.join(heavy, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_salts")
    )
    return salted.join(copied, [key, "_salt"], how).drop("_salt")
