"""Expressions over arrays of logits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_softmax(logits: Column) -> Column:
    """Log probabilities; shifted by the maximum so that nothing overflows."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    shift = top + F.log(total)
    return F.transform(logits, lambda x: x.cast("double") - shift)


def negative_log_likelihood(logits: Column, label: Column) -> Column:
    """-log p(label); needs the one log probability only."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return top + F.log(total) - F.element_at(logits, label.cast("int") + 1).cast("double")


def argmax(logits: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
