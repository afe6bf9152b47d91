"""Unicode clean-up and word splitting; all run inside the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, functions as F

from .bind import let

# The code-point ranges that count as ideographs.
IDEOGRAPHS = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
)
PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
_HANGUL = (0xAC00, 0xD7A3)


def decode_text(data: Column) -> Column:
    """UTF-8 bytes to text; bytes that are no UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def clean_characters(text: Column) -> Column:
    """Drop control and format characters; every Unicode blank becomes a blank."""
    dropped = F.regexp_replace(text, r"[\x00\x{FFFD}[\p{Cc}\p{Cf}&&[^\t\n\r]]]", "")
    return F.regexp_replace(dropped, r"[\t\n\r\p{Zs}]", " ")


def space_ideographs(text: Column) -> Column:
    """Put blanks around every ideograph."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IDEOGRAPHS)
    return F.regexp_replace(text, f"([{ranges}])", " $1 ")


@functools.cache
def _unaccented() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose decomposition, less its marks, differs from themselves.

    One-to-one cases feed ``translate``; the few longer ones are replaced singly.
    """
    single_from, single_to, longer = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or _HANGUL[0] <= code <= _HANGUL[1]:
            continue
        if not unicodedata.decomposition(char) or unicodedata.category(char) == "Mn":
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base == char:
            continue
        if len(base) == 1:
            single_from.append(char)
            single_to.append(base)
        else:
            longer.append((char, base))
    return "".join(single_from), "".join(single_to), tuple(longer)


def _hangul_letters(char: Column) -> Column:
    """Decompose one Hangul syllable into its two or three letters."""
    index = F.ascii(char) - F.lit(_HANGUL[0])

    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE")

    tail = F.pmod(index, F.lit(28))
    return F.concat(
        letter(F.floor(index / 588) + 0x1100),
        letter(F.floor(F.pmod(index, F.lit(588)) / 28) + 0x1161),
        F.when(tail > 0, letter(tail + 0x11A7)).otherwise(F.lit("")),
    )


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without the non-spacing marks.

    ASCII texts are left as they are, and only texts with a character of a longer
    decomposition go through the whole chain.
    """
    source, target, longer = _unaccented()
    rare = "[가-힣" + "".join(c for c, _ in longer) + "]"

    def without_marks(t: Column) -> Column:
        return F.regexp_replace(F.translate(t, source, target), r"\p{Mn}", "")

    def whole_chain(t: Column) -> Column:
        for char, base in longer:
            t = F.replace(t, F.lit(char), F.lit(base))
        letters = F.transform(
            F.split(t, ""), lambda c: F.when(F.rlike(c, F.lit("[가-힣]")), _hangul_letters(c)).otherwise(c)
        )
        return without_marks(F.array_join(letters, ""))

    def stripped(t: Column) -> Column:
        is_ascii = ~F.rlike(t, F.lit(r"[^\x00-\x7F]"))
        is_rare = F.rlike(t, F.lit(rare))
        return F.when(is_ascii, t).when(is_rare, whole_chain(t)).otherwise(without_marks(t))

    return let(text, stripped)


def space_punctuation(text: Column) -> Column:
    """Put blanks around every punctuation character."""
    return F.regexp_replace(text, f"({PUNCTUATION})", " $1 ")


def word_array(text: Column) -> Column:
    """Split at blanks and at line or paragraph separators; no empty words."""
    return F.filter(F.split(text, r"[ \x{2028}\x{2029}]+"), lambda w: w != "")


_SIGNS = PUNCTUATION[1:-1]
_WORD_OR_SIGN = rf"[^ \x{{2028}}\x{{2029}}{_SIGNS}]+|[{_SIGNS}]"
_ASCII_WORD_OR_SIGN = r"[a-zA-Z0-9]+|[!-/:-@\[-`{-~]"
_ASCII_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Words and single punctuation characters of a text.

    An ASCII text has no ideographs, accents or Unicode blanks, so one pattern finds its
    words; most have no control characters to drop either.
    """
    plain = F.when(F.rlike(text, F.lit(_ASCII_CONTROLS)), F.regexp_replace(text, _ASCII_CONTROLS, "")).otherwise(text)
    spaced = space_ideographs(clean_characters(text))
    if lower:
        plain, spaced = F.lower(plain), strip_accents(F.lower(spaced))
    found = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    is_ascii = ~F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    return F.when(is_ascii, found(plain, _ASCII_WORD_OR_SIGN)).otherwise(found(spaced, _WORD_OR_SIGN))
