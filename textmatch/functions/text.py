"""Text-cleaning expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..options import DEFAULTS, OPENING_BORDERS, PARAGRAPH_SEPARATORS
from .bind import let


def delete_newlines(text: Column, newline: str = "") -> Column:
    """Delete real line breaks and escaped ones (backslash + n)."""
    escaped = F.replace(text, F.lit("\\n"), F.lit(newline))
    return F.replace(escaped, F.lit("\n"), F.lit(newline))


def letters_only(text: Column, newline: str = "") -> Column:
    """Keep Latin letters, blanks and dots; glue a dot to the word before it."""
    kept = F.regexp_replace(delete_newlines(text, newline), "[^.a-zA-Z ]+", "")
    return F.replace(kept, F.lit(" ."), F.lit("."))


_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def single_blanks(text: Column) -> Column:
    """Collapse runs of any white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def trimmed(text: Column) -> Column:
    """Without the white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def occurrences(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_spaces(text: Column) -> Column:
    return occurrences(text, " ")


def is_important(text: Column, min_space: int = DEFAULTS.min_space) -> Column:
    """True for a text with more than ``min_space`` blanks."""
    return count_spaces(text) > min_space


def is_contents_list(text: Column, max_dots: int = DEFAULTS.max_dots) -> Column:
    """True for a table of contents: too many dots."""
    return occurrences(text, ".") >= max_dots


def _clean(text: Column, newline: str) -> Column:
    # After letters_only the blank is the only white space left.
    return F.trim(F.regexp_replace(letters_only(text, newline), " +", " "))


def raw_sentences(text: Column) -> Column:
    """Lower-case and split at dots; empty pieces are kept."""
    return F.split(F.lower(text), "[.]", -1)


def sentence_array(text: Column, min_space: int = DEFAULTS.min_space, newline: str = "") -> Column:
    """Clean sentences of one text, in order, short ones left out.

    The text is cleaned whole, in generated code: cleaning leaves the dots, where
    sentences end, and what is left to do per sentence is to trim it.
    """
    whole = F.regexp_replace(letters_only(F.lower(text), newline), " +", " ")
    cleaned = F.transform(F.split(whole, "[.]", -1), lambda s: F.trim(s))
    return F.filter(cleaned, lambda s: is_important(s, min_space))


def after_front_matter(text: Column, borders: Sequence[str] = OPENING_BORDERS) -> Column:
    """Text between the first two occurrences of the first border that occurs."""
    cut = [F.when(F.contains(text, F.lit(b)), F.split_part(text, F.lit(b), F.lit(2))) for b in borders]
    return F.coalesce(*cut, text)


def is_regular_report(text: Column, max_pieces: int = DEFAULTS.max_chapter_pieces, word: str = "BAB") -> Column:
    """True when the chapter word splits the text into few pieces."""
    return F.size(F.split(text, "\\Q" + word + "\\E", -1)) <= max_pieces


def chapter_patterns(chapters: tuple[str, str] = DEFAULTS.chapters, word: str = "BAB") -> list[str]:
    """The four spacings of ``BAB III ... BAB V``, one or two blanks at each end."""
    start, end = chapters
    return [f"(?s){word}{a}{start}(.*){word}{b}{end}" for a in (" ", "  ") for b in (" ", "  ")]


def required_chapters(
    text: Column,
    chapters: tuple[str, str] = DEFAULTS.chapters,
    max_pieces: int = DEFAULTS.max_chapter_pieces,
    word: str = "BAB",
) -> Column:
    """Cut a regular report to the wanted chapters; other texts stay whole."""
    cuts = [
        F.when(F.rlike(text, F.lit(p)), F.regexp_extract(text, p, 0))
        for p in chapter_patterns(chapters, word)
    ]
    return F.when(is_regular_report(text, max_pieces, word), F.coalesce(*cuts, text)).otherwise(text)


def paragraph_pieces(
    text: Column,
    separators: Sequence[str] = PARAGRAPH_SEPARATORS,
    min_paragraphs: int = DEFAULTS.min_paragraphs,
) -> Column:
    """Split at the first separator that gives enough pieces, else at the last."""

    def pieces(sep: str) -> Column:
        return F.split(text, "\\Q" + sep + "\\E", -1)

    tried = [let(pieces(s), lambda p: F.when(F.size(p) > min_paragraphs, p)) for s in separators[:-1]]
    return F.coalesce(*tried, pieces(separators[-1]))


def paragraph_array(
    text: Column,
    separators: Sequence[str] = PARAGRAPH_SEPARATORS,
    min_paragraphs: int = DEFAULTS.min_paragraphs,
    min_space: int = DEFAULTS.min_space,
    newline: str = "",
) -> Column:
    """Clean paragraphs of one text, in order, short ones left out."""
    cleaned = F.transform(
        paragraph_pieces(text, separators, min_paragraphs), lambda p: _clean(p, newline)
    )
    return F.filter(cleaned, lambda p: is_important(p, min_space))
