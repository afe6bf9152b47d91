"""Global positions, running totals, chunks and shards without a one-task window.

A running total over a whole table cannot use one unpartitioned window at size.
Here rows are grouped by prefixes of the sort key; totals per prefix are summed
level by level, and every window stays inside one small group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RADIX_BITS = 16


def integer_levels(key: Column) -> list[Column]:
    """Prefixes of a 64-bit integer key, coarse to fine, 65,536 children each."""
    return [F.shiftright(key.cast("bigint"), RADIX_BITS * i) for i in (3, 2, 1)]


def hash_levels(digest: Column) -> list[Column]:
    """Prefixes of a hex digest, coarse to fine; digests spread evenly."""
    return [F.substring(digest, 1, 3), F.substring(digest, 1, 6)]


def running_total(
    df: DataFrame,
    levels: Sequence[Column],
    order: Sequence[str | Column],
    value: Column,
    name: str = "running_total",
    within: Sequence[str] = (),
) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and including the current one.

    ``levels`` are prefixes of the sort key, coarse to fine, and ``order`` is the
    full key. ``order`` should be unique; the coarsest level must have few values.
    ``within`` restarts the total for each value of these columns.
    """
    within = list(within)
    keys = [f"_level{i}" for i in range(len(levels))]
    leveled = df.withColumns(dict(zip(keys, levels))).withColumn("_value", value)
    totals = [leveled.groupBy(*within, *keys).agg(F.sum("_value").alias("_total"))]
    for depth in range(len(keys) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*within, *keys[:depth]).agg(F.sum("_total").alias("_total")))

    def before(table: DataFrame, depth: int) -> DataFrame:
        window = W.partitionBy(*within, *keys[:depth])
        window = window.orderBy(keys[depth]).rowsBetween(W.unboundedPreceding, -1)
        return table.withColumn("_before", F.coalesce(F.sum("_total").over(window), F.lit(0)))

    offsets = before(totals[0], 0).drop("_total")
    for depth in range(1, len(keys)):
        parent = offsets.withColumnRenamed("_before", "_parent")
        finer = before(totals[depth], depth).drop("_total")
        offsets = finer.join(parent, within + keys[:depth]).select(
            *within, *keys[: depth + 1], (F.col("_before") + F.col("_parent")).alias("_before")
        )
    window = W.partitionBy(*within, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        leveled.join(offsets, within + keys)
        .withColumn(name, F.col("_before") + F.sum("_value").over(window))
        .drop(*keys, "_before", "_value")
    )


def position_by_id(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """0-based position of every row in the order of a unique integer key."""
    total = running_total(df, integer_levels(F.col(key)), [key], F.lit(1), name)
    return total.withColumn(name, F.col(name) - 1)


def position_by_digest(df: DataFrame, digest: str, ties: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position in digest order: a shuffled numbering."""
    total = running_total(df, hash_levels(F.col(digest)), [digest, *ties], F.lit(1), name)
    return total.withColumn(name, F.col(name) - 1)


def file_offsets(counts: DataFrame, key: str = "file_id", n: str = "n_vectors") -> DataFrame:
    """Start and end offset of every file, from one row per file."""
    ends = running_total(counts, integer_levels(F.col(key)), [key], F.col(n), "end_off")
    return ends.select(key, (F.col("end_off") - F.col(n)).alias("start_off"), "end_off")


def chunks(df: DataFrame, size: int, position: str = "position", name: str = "chunk") -> DataFrame:
    """Number of the fixed-size chunk that a position falls in."""
    return df.withColumn(name, F.floor(F.col(position) / F.lit(size)).cast("bigint"))


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count("*")).scalar()


def full_chunks(df: DataFrame, size: int, position: str = "position", name: str = "chunk") -> DataFrame:
    """Like :func:`chunks`, without the rows of a short last chunk."""
    return chunks(df, size, position, name).filter(F.col(name) < F.floor(row_count(df) / size))


def near_equal_runs(df: DataFrame, n: int, position: str = "position", name: str = "run") -> DataFrame:
    """0-based run of each row when split into ``n`` runs, the first ones longer."""
    at, base, extra = F.col(position), F.floor(F.col("_rows") / n), F.pmod(F.col("_rows"), F.lit(n))
    in_long = F.floor(at / (base + 1))
    in_short = extra + F.floor((at - extra * (base + 1)) / F.greatest(base, F.lit(1)))
    return (
        df.withColumn("_rows", row_count(df))
        .withColumn(name, F.when(at < extra * (base + 1), in_long).otherwise(in_short).cast("bigint"))
        .drop("_rows")
    )


def shards(df: DataFrame, n: int, position: str = "position", name: str = "shard") -> DataFrame:
    """Round-robin shard of each row."""
    return df.withColumn(name, F.pmod(F.col(position), F.lit(n)).cast("int"))


def document_numbers(lines: DataFrame, name: str = "doc_no") -> DataFrame:
    """Document number of each line within its file; blank lines end a document.

    ``lines`` has ``file``, ``block`` (the file split), ``line_no`` and ``line``.
    Blank lines are counted per block, so no task sees more than one block of a
    file, however large the file. The blank lines themselves are dropped.
    """
    is_blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    numbered = running_total(
        lines, [F.col("block")], ["line_no"], is_blank.cast("bigint"), name, within=["file"]
    )
    return numbered.filter(~is_blank)
