"""Metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import argmax, negative_log_likelihood


def _hit(prediction: str, label: str) -> Column:
    return (F.col(prediction) == F.col(label)).cast("double")


def accuracy(prediction: str, label: str, weight: str | None = None) -> Column:
    """Share of right predictions, weighted when a weight column is given."""
    if weight is None:
        return F.avg(_hit(prediction, label))
    return F.sum(F.col(weight) * _hit(prediction, label)) / F.sum(weight)


def mean(value: str, weight: str | None = None) -> Column:
    return F.avg(value) if weight is None else F.sum(F.col(weight) * F.col(value)) / F.sum(weight)


def masked_batch_loss(nll: str, weight: str) -> Column:
    """Weighted loss with the small constant that guards an all-padding batch."""
    return F.sum(F.col(weight) * F.col(nll)) / (F.sum(weight) + F.lit(1e-5))


def pair_batch_loss(nll: str) -> Column:
    return F.avg(nll)


def with_predictions(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Add the predicted class and the loss of each example."""
    return df.withColumns(
        {"prediction": argmax(F.col(logits)), "nll": negative_log_likelihood(F.col(logits), F.col(label))}
    )


def evaluate(masked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The four metrics of a model as one row.

    ``masked`` has ``logits``, ``label`` and ``weight``; ``pairs`` has ``logits`` and ``label``.
    """
    tokens = with_predictions(masked).agg(
        accuracy("prediction", "label", "weight").alias("masked_lm_accuracy"),
        mean("nll", "weight").alias("masked_lm_loss"),
    )
    sentences = with_predictions(pairs).agg(
        accuracy("prediction", "label").alias("next_sentence_accuracy"),
        mean("nll").alias("next_sentence_loss"),
    )
    # Two one-row tables.
    return tokens.withColumn("_k", F.lit(1)).join(sentences.withColumn("_k", F.lit(1)), "_k").drop("_k")


def as_lines(metrics: DataFrame) -> DataFrame:
    """A row of metrics as sorted ``key = value`` lines."""
    named = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in metrics.columns])
    rows = metrics.select(F.inline(named)).orderBy("key")
    return rows.select(F.concat_ws(" = ", "key", "value").alias("value"))
