"""Documents to clean sentences or paragraphs, one row each and no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..options import DEFAULTS, OPENING_BORDERS, PARAGRAPH_SEPARATORS, Options


def sentences(
    docs: DataFrame, options: Options = DEFAULTS, key: str = "doc_id", text: str = "text", newline: str = ""
) -> DataFrame:
    """Clean sentences (key, pos, sentence); ``pos`` counts the kept ones."""
    kept = T.sentence_array(F.col(text), options.min_space, newline)
    return docs.select(key, F.posexplode(kept).alias("pos", "sentence"))


def paragraphs(
    docs: DataFrame,
    options: Options = DEFAULTS,
    key: str = "doc_id",
    text: str = "text",
    borders: Sequence[str] = OPENING_BORDERS,
    separators: Sequence[str] = PARAGRAPH_SEPARATORS,
    chapter_word: str = "BAB",
    newline: str = "",
    drop_contents: bool = False,
) -> DataFrame:
    """Clean paragraphs of the required chapters (key, pos, sentence)."""
    body = docs.select(key, T.after_front_matter(F.col(text), borders).alias("_body"))
    chapter = T.required_chapters(
        F.col("_body"), options.chapters, options.max_chapter_pieces, chapter_word
    )
    kept = T.paragraph_array(
        F.col("_chapter"), separators, options.min_paragraphs, options.min_space, newline
    )
    if drop_contents:
        kept = F.filter(kept, lambda p: ~T.is_contents_list(p, options.max_dots))
    cut = body.select(key, chapter.alias("_chapter"))
    return cut.select(key, F.posexplode(kept).alias("pos", "sentence"))


def clean_texts(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join the sentences of each document to one text, a line per sentence."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    lines = F.transform(ordered, lambda s: s["sentence"])
    return pieces.groupBy(key).agg(F.array_join(lines, "\n").alias("text"))


def not_done(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose key is not in the output yet."""
    return docs.join(done.select(key), key, "left_anti")
