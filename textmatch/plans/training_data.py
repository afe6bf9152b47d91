"""The whole training-data job: text to masked sentence-pair records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import pretraining as P
from ..operators.positions import shards
from ..operators.tokens import fits, looked_up, tokenize
from ..options import DEFAULTS, Options
from ..session import written

KEYS = ["round", "doc_id", "start"]


def instances(segs: DataFrame, vocab: DataFrame, options: Options = DEFAULTS, stored: bool = False) -> DataFrame:
    """Masked instances from tokenised segments (doc_id, seg_no, tokens), with their shuffled ``position``.

    Every row of the plan becomes one instance, so the plan is numbered and no instance is moved
    for it. ``stored`` segments are a written table that is numbered already.
    """
    # The segments feed the plan and both halves of the pairs, the instances their masks.
    segs = segs if stored else P.stored_segments(segs)
    ranked = written(P.ranked_documents(P.document_lengths(segs), options.seed), "documents")
    plan = written(P.plan_chunks(ranked, options), "plan")
    plan = written(P.shuffled(plan, options.seed, KEYS), "numbered-plan")
    pairs = P.truncated(P.sentence_pairs(plan, segs, ranked, options), options)
    picked = written(P.picked_positions(P.assembled(pairs), options), "instances")
    return P.masked(picked, vocab, options)


def records(masked: DataFrame, vocab: DataFrame, n_shards: int, options: Options = DEFAULTS) -> DataFrame:
    """Shuffled, padded records with their shard.

    Tokens and labels go through the vocabulary in one lookup. Rows that have no ``position``
    yet are read twice and moved to be numbered.
    """
    both = masked.withColumn("_all", F.concat("tokens", "masked_lm_labels"))
    n = F.size("tokens")
    with_ids = looked_up(both, vocab, KEYS, "_all", "token", "id", "_ids").withColumns(
        {"ids": F.slice("_ids", 1, n), "label_ids": F.slice("_ids", n + 1, F.size("masked_lm_labels"))}
    ).drop("_all", "_ids")
    numbered = with_ids if "position" in with_ids.columns else P.shuffled(with_ids, options.seed, KEYS)
    return P.padded_records(shards(numbered, n_shards), options)


def training_records(
    lines: DataFrame, vocab: DataFrame, n_shards: int = 1, options: Options = DEFAULTS
) -> DataFrame:
    """Sentence lines (doc_id, seg_no, line) to training records."""
    segs = tokenize(lines, vocab, ("doc_id", "seg_no"), "line").drop("ids")
    return records(kept(instances(segs, vocab, options), vocab), vocab, n_shards, options)


def kept(masked: DataFrame, vocab: DataFrame) -> DataFrame:
    """Written masked instances if the look-ups of their records read them twice, by a join."""
    return masked if fits(vocab) else written(masked, "masked")
