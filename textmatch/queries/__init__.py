"""Queries over the test tables, one per operator."""

from __future__ import annotations


def load():
    """Import all query modules; returns (queries, SQL)."""
    from . import common, texts, tokens, training, vectors  # noqa: F401

    return common.QUERIES, common.SQL
