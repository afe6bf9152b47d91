"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are the unit. Each source has a target share of all words; a target stops at
``max_repeats`` times the source's size and the excess is shared again by weight. The mix
is made of blocks of equal size. Block number m goes to the source with the highest
quotient share / (2 k + 1), k being the blocks it has; shard j takes a run of consecutive
blocks, so its quotas are whole numbers that add up to the source's total.

The blocks a source holds after m steps follow from its share up to a bounded number of
open seats (n sources leave at most n / 2 + 1 per unit of share), so only those quotients
are ranked and no step-by-step loop runs, whatever the number of blocks.

A source's documents lie end to end in a seeded order and its blocks are cut from that
stream, which starts again when it is used up. A document's position comes from
running totals over prefixes of the seeded digest, so a source that holds most of the
corpus is never one group.

Defined results: a null text has size 0; a null source is a source of its own, after all
others; a null id is an id like any other; repeated rows are separate documents in the
stream; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.draws import digest
from ..operators.positions import running_total
from ..session import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK = 64  # words
SHARDS = 16
SEED = 42


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, rank, source_size, target.

    Sorted by limit / weight, the sources at their limit come first; the level of the
    others is what is left over by the weight that is left. Windows here see one row per
    source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.get(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights)))))
        .withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    )
    fill = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = sources.withColumn("level", level).withColumn("is_full", F.col("limit") / F.col("weight") <= F.col("level"))
    open_level = F.min(F.when(~F.col("is_full"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(whole)
    target = F.when(F.col("is_full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("open.level")))
    return leveled.withColumn("open", open_level).select("source", "rank", "source_size", target.alias("target"))


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Blocks of each source up to and including each shard: rank, shard, blocks."""
    whole = W.partitionBy()
    shares = (
        sources.withColumn("n", F.count("*").over(whole))
        .withColumn("all", F.sum("source_size").over(whole))  # what the targets share out; exact in any order
        .filter("target > 0")
        .select("rank", "n", (F.col("target") / F.col("all")).alias("p"), F.ceil(F.col("all") / block).alias("seats"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("seats", F.floor(F.col("seats") * (F.col("shard") + 1) / F.lit(shards)))
    )
    fair, slack = F.col("p") * F.col("seats"), F.col("p") * F.col("n") / 2 + 0.5
    bounded = shares.withColumn("low", F.greatest(F.floor(fair - slack), F.lit(0))).withColumn("high", F.ceil(fair + slack))
    of_shard = W.partitionBy("shard")
    left = F.col("seats") - F.sum("low").over(of_shard)
    seats = bounded.withColumn("left", left).withColumn("k", F.explode(F.sequence(F.col("low"), F.col("high"))))
    quotient = F.col("p") / (2 * F.col("k") + 1)
    taken = F.row_number().over(of_shard.orderBy(quotient.desc(), "rank", "k")) <= F.col("left")
    return (
        seats.withColumn("taken", taken.cast("long")).groupBy("rank", "shard", "low")
        .agg(F.sum("taken").alias("more")).select("rank", "shard", (F.col("low") + F.col("more")).alias("blocks"))
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS,
    block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, shards of the mix).

    Documents: doc_id, source, size, source_size, target, first (place of its first word
    in its source's stream), taken (words the mix takes from it, repeats counted).
    Shards: rank, source, source_size, shard, low, high: the run of the source's endless
    stream that the shard holds; :func:`slices` turns it into parts of documents.
    """
    sizes = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .withColumn("order", digest(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size")),
        "sizes",
    )
    sources = written(targets(sizes, weights, max_repeats), "targets")
    words = F.least(F.col("blocks") * block, F.col("source_size") * max_repeats)
    runs = quotas(sources, block, shards).join(sources, "rank").withColumn("high", words)
    by_shard = W.partitionBy("rank").orderBy("shard")
    runs = written(
        runs.withColumn("low", F.coalesce(F.lag("high").over(by_shard), F.lit(0)))
        .select("rank", "source", "source_size", "shard", "low", "high"), "shards",
    )
    total = runs.groupBy("rank").agg(F.max("high").alias("take"))
    plan = sources.join(total, "rank", "left").withColumn("take", F.coalesce("take", F.lit(0)))
    placed = _placed(sizes, plan)
    levels = [F.substring("order", 1, 2), F.substring("order", 1, 5)]
    placed = running_total(placed, levels, ["order", "doc_id", "size"], F.col("size"), "end", within=["rank"])
    first = F.col("end") - F.col("size")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    rest = F.when(F.col("source_size") > 0, F.pmod("take", "source_size")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - first))
    documents = placed.select(
        "doc_id", "source", "size", "source_size", "target", first.alias("first"),
        (rounds * F.col("size") + part).cast("long").alias("taken"),
    )
    return documents, runs


def _placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Sizes with their source's plan; a null source meets the null source."""
    name = F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("source", F.lit("")))
    return sizes.withColumn("_name", name).join(plan.withColumn("_name", name).drop("source"), "_name").drop("_name")


def slices(documents: DataFrame, runs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Parts of documents in each shard: doc_id, source, shard, round, from_word, n_words."""
    use = documents.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats))))
    use = use.withColumn("at", F.col("first") + F.col("round") * F.col("source_size")).drop("source_size", "target", "taken")
    runs = runs.filter("high > low").select(F.col("source").alias("_source"), "shard", "low", "high")
    begin, end = F.greatest("at", "low"), F.least(F.col("at") + F.col("size"), F.col("high"))
    on = use["source"].eqNullSafe(F.col("_source")) & (F.col("at") < F.col("high")) & (F.col("at") + F.col("size") > F.col("low"))
    return use.join(runs, on).select(
        "doc_id", "source", "shard", "round", (begin - F.col("at")).alias("from_word"), (end - begin).alias("n_words"),
    )
