"""Repeatable random draws.

A draw is a hash of the seed and the keys of a row, so it does not depend on
partitioning or on a retried task, and plain SQL gives the same number.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, functions as F


def digest(seed: int, *keys: Column | str) -> Column:
    """Hex digest of the seed, a purpose and row keys."""
    parts = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def integer(draw: Column, count: Column) -> Column:
    """Turn a uniform draw into 0 .. count-1."""
    return F.floor(draw * count).cast("bigint")


# ---- the same draws inside a task, where a row has many ----------------------------------


def row_keys(*keys: Column | str) -> Column:
    """Row keys as one text, in the form that ``digests`` takes."""
    return F.concat_ws("|", F.lit(""), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])


def digests(seed: int, purpose: str, keys: list[bytes], row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``digest`` of purpose, row keys and a place in the row, as two unsigned integers that sort as it does."""
    start = f"{seed}|{purpose}".encode()
    heads = [start + k + b"|" for k in keys]
    tails = [b"%d" % i for i in range(int(place.max(initial=-1)) + 1)]
    if len(row) and max(map(len, heads)) + len(tails[-1]) <= _ONE_BLOCK:
        return _digests_at_once(heads, tails, row, place)
    joined = b"".join([md5(heads[r] + tails[i]).digest() for r, i in zip(row.tolist(), place.tolist())])
    return np.frombuffer(joined, dtype=">u8").reshape(-1, 2)


# MD5 (RFC 1321) of many short texts at once: each fits one block of 16 words of 32 bits.
_ONE_BLOCK = 55
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_CHUNK = 8192  # texts whose words stay in a core's cache


def _blocks(texts: list[bytes]) -> np.ndarray:
    """Texts of at most 64 bytes, filled up with zeros, as 16 rows of words."""
    return np.frombuffer(b"".join([t.ljust(64, b"\0") for t in texts]), dtype="<u4").reshape(-1, 16).T.astype(np.uint32)


def _digests_at_once(heads: list[bytes], tails: list[bytes], row: np.ndarray, place: np.ndarray) -> np.ndarray:
    sizes = np.array([len(h) for h in heads])
    used = np.unique(sizes)
    # A block is a head, and behind it a tail with MD5's end mark and bit count.
    ends = [
        (b"\0" * n + t + b"\x80").ljust(56, b"\0") + (8 * (n + len(t))).to_bytes(8, "little") for n in used.tolist() for t in tails
    ]
    first, last = _blocks(heads), _blocks(ends)
    end = np.searchsorted(used, sizes)[row] * len(tails) + place
    out = np.empty((len(row), 4), dtype="<u4")
    for at in range(0, len(row), _CHUNK):
        part = slice(at, at + _CHUNK)
        out[part] = _md5(first[:, row[part]] | last[:, end[part]]).T
    return out.view(">u8")


def _md5(words: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            mix, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mix, at = c ^ (d & (b ^ c)), 5 * i + 1
        elif i < 48:
            mix, at = b ^ c ^ d, 3 * i + 5
        else:
            mix, at = c ^ (b | ~d), 7 * i
        mix += a
        mix += _SINES[i]
        mix += words[at % 16]
        a, d, c, b = d, c, b, b + ((mix << np.uint32(_TURNS[i])) | (mix >> np.uint32(32 - _TURNS[i])))
    return np.stack([a, b, c, d]) + np.array(_START, np.uint32)[:, None]


def uniforms(seed: int, purpose: str, keys: list[bytes], row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``uniform`` of the same."""
    return (digests(seed, purpose, keys, row, place)[:, 0] >> 32) / 2.0**32
