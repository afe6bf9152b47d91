"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times, or inside a lambda, and compute it once.

    Spark inlines a column computed before into the lambda that refers to it, where it
    would be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
