"""Words of many texts at once, as hashes in numpy arrays.

Texts are joined to one byte buffer and cut at white space in a few array operations,
so a task needs no Python loop over words. A buffer holds about ``LIMIT`` bytes; a longer
text is cut at white space and continues in the next buffer, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

LIMIT = 1 << 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


class Piece(NamedTuple):
    """Part of a buffer that belongs to one text."""

    text: int  # position in the input
    start: int
    end: int
    first: bool  # the text begins here
    last: bool  # the text ends here


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        size = 1 << max(16, (size - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = _powers[base] = np.multiply.accumulate(table)
    return table


def hash_slices(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices; equal bytes give equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[buffer] * _power_table(_BASE, len(buffer))[: len(buffer)], out=sums[1:])
    inverse = _power_table(pow(_BASE, -1, 1 << 64), len(buffer))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hash_word(word: bytes) -> int:
    """The same hash for one word."""
    buffer = np.frombuffer(word, dtype=np.uint8)
    return int(hash_slices(buffer, np.array([0]), np.array([len(word)]))[0])


def lower(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def buffers(texts: Iterable[bytes], limit: int = LIMIT) -> Iterator[tuple[np.ndarray, list[Piece]]]:
    """Texts joined to buffers; a blank follows each piece."""
    parts: list[bytes] = []
    pieces: list[Piece] = []
    size = 0

    def flush():
        return np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8), list(pieces)

    for number, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > limit:
                window = np.frombuffer(text, dtype=np.uint8, count=limit, offset=at)
                blanks = np.flatnonzero(_SPACE[window])
                if len(blanks):
                    end = at + int(blanks[-1]) + 1
                else:  # one word longer than a buffer stays whole
                    following = next((i for i in range(at + limit, len(text)) if _SPACE[text[i]]), len(text))
                    end = following
            part = text[at:end]
            if parts and size + len(part) > limit:
                yield flush()
                parts, pieces, size = [], [], 0
            parts.append(part)
            pieces.append(Piece(number, size, size + len(part), at == 0, end == len(text)))
            size += len(part) + 1
            at = end
            if at >= len(text):
                break
    if parts:
        yield flush()


def word_slices(buffer: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer; ``outside`` tells which bytes are in none."""
    inside = np.concatenate(([False], ~outside[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def owners(starts: np.ndarray, pieces: list[Piece]) -> np.ndarray:
    """Piece number of each slice."""
    return np.searchsorted(np.array([p.start for p in pieces]), starts, side="right") - 1
