"""Quality rules: counts of words, lines and repeats, and bands of n-gram perplexity by language.

The model is an interpolated modified Kneser-Ney model of the bytes of a text, one of each
language, over windows of ``ORDER`` bytes. Bytes and not words: all pairs of words of a corpus
need more than twice its size on disk, while windows of bytes repeat, so a task passes on a
small part of what it reads; and no word is unknown.

Counting. A task sums the windows of its texts by language and passes on blocks of sorted
windows for each shard, which follows from the hash of a window, so no frequent window or
language is one task's alone. A shard's task sums its blocks, writes a file of sorted hashes
with their counts, and passes on the windows one byte shorter, one count each (continuation
counts), and the totals of contexts. Levels follow from the longest to single bytes.

Scoring. Workers map the files to memory and look up the windows of a batch of texts; those
met before are kept in a table of fixed size. The base counts are taken in the same pass.

Bands. The cost of a text is -log10 of its probability by byte. Median and median absolute
deviation of all documents with a word come from counts by language and step of
``STEP``; a document is kept if its cost is within ``WIDTH`` deviations of the median of its
language, both ends included. ``WIDTH`` counts deviations scaled to those of a normal law.

Defined results: null and empty texts have no word and no cost; they are not kept and teach
nothing. A null language is a language of its own. A language with few documents has a band
about these few. Every row counts, repeated ones too. Texts are read whole, in pieces where
they are longer than a buffer. An empty table gives no rows. Other columns are passed on.
Windows, words and lines are told apart by 64-bit hashes. A missing file is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path, written
from .kneser_ney import Shard, _map, _narrow, _save, _wide, mounted, shard_of
from .words import LIMIT, Piece, buffers, hash_slices, hash_word, mix, owners, word_slices

ORDER = 6  # bytes of a window; at most 8 fit a number
SHARD_BYTES = 64 << 20  # text bytes behind one shard
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent
WIDTH = 8.0
STEP = 0.0005
CACHE_BITS = 20
_HOLD = 1 << 22  # windows a task gathers before it sums them
_KEEP = 1 << 21  # sums a task holds before it passes them on
_END = 0x0A  # no word holds it: stands before and behind every text
_U = np.uint64
_WINDOW, _CONTEXT, _SUMMARY = range(3)
_BLOCK = "kind int, level int, shard int, lang string, keys binary, counts binary"
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), ("lang", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()),
])
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# ---- windows of bytes ------------------------------------------------------------


def windows(buffer: np.ndarray, pieces: list[Piece], carry: bytes, order: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Windows that end at each byte of the words, of one blank after each, of one end mark.

    A window is a number, its last byte lowest. ``carry`` has the bytes before the first
    piece where its text began in another buffer. Returns (text of each window, windows,
    bytes to carry on).
    """
    starts, ends = word_slices(buffer)
    kept = ~_GAP[buffer]
    kept[ends] = True  # a blank follows every piece
    data = buffer.copy()
    data[ends] = 0x20
    owner = owners(starts, pieces)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)[: len(owner)])
    closed = np.array([p.last for p in pieces])
    data[ends[last[closed[owner[last]]]]] = _END
    at = np.flatnonzero(kept)
    data = data[at]
    owner = owners(at, pieces)
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    key = data.astype(np.uint64)
    opened = bool(len(owner)) and not pieces[owner[0]].first
    for j in range(1, order):
        before = np.full(len(data), _END, dtype=np.uint8)
        before[j:] = data[:-j] if j < len(data) else data[:0]
        for i in range(j):  # byte i of a text reaches j - i bytes before it
            here = begin[begin + i < np.append(begin[1:], len(data))] + i
            before[here] = _END
            if opened and i < len(data) and (len(begin) == 1 or i < begin[1]):
                before[i] = carry[i - j]
        key |= before.astype(np.uint64) << _U(8 * j)
    texts = np.array([p.text for p in pieces])[owner]
    if not pieces[-1].last:
        tail = data[begin[-1] :].tobytes() if len(owner) and owner[-1] == len(pieces) - 1 else b""
        lead = bytes([_END]) * (order - 1) if pieces[-1].first else carry
        carry = (lead + tail)[-(order - 1) :] if order > 1 else b""
    return texts, key, carry



def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values (a row each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def _by_language(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str | None, np.ndarray, list[bytes]]]:
    """Rows of each language and their texts."""
    names = batch.column(lang).dictionary_encode("encode")
    codes = names.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
    for a, b in zip(cuts, cuts[1:]):
        rows = order[a:b]
        texts = batch.column(text).take(pa.array(rows)).to_pylist()
        yield names.dictionary[int(codes[rows[0]])].as_py(), rows, [(t or "").encode("utf-8", "replace") for t in texts]


@lru_cache(1 << 16)
def seed(lang: str | None) -> np.uint64:
    return _U(hash_word(b"\xff" if lang is None else lang.encode("utf-8", "replace")))


def hashed(keys: np.ndarray, lang: str | None) -> np.ndarray:
    return mix(mix(keys) + seed(lang))


# ---- counting --------------------------------------------------------------------


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, so that equal bytes lie together."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _blocks(kind: int, level: int, lang: str | None, keys: np.ndarray, values: np.ndarray, shards: int) -> Iterator[tuple]:
    shard = shard_of(hashed(keys, lang), shards)
    for s in np.unique(shard):
        own = shard == s  # still sorted by key
        yield kind, level, int(s), lang, _planes(keys[own]), _narrow(values[own].ravel())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _count(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks of windows from rows of (lang, text)."""
    sums: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    fresh: dict[str | None, list[np.ndarray]] = {}
    gathered = held = 0

    def settle() -> int:
        for lang, arrays in fresh.items():
            keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
            old = sums.get(lang, [])
            parts = [*old, (keys, counts.astype(np.uint64))]
            sums[lang] = [summed(*(np.concatenate(p) for p in zip(*parts)))]
        fresh.clear()
        return sum(len(s[0][0]) for s in sums.values())

    def flush():
        rows = [row for lang, s in sums.items() for row in _blocks(_WINDOW, order, lang, *s[0], shards)]
        sums.clear()
        return _batch(rows)

    for batch in batches:
        for lang, _, texts in _by_language(batch, 0, 1):
            carry = b""
            for buffer, pieces in buffers(texts):
                _, keys, carry = windows(buffer, pieces, carry, order)
                fresh.setdefault(lang, []).append(keys)
                gathered += len(keys)
                if gathered >= _HOLD:
                    held, gathered = settle(), 0
                    if held >= _KEEP:
                        yield flush()
    if fresh:
        settle()
    if sums:
        yield flush()


def _reduce(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Sum the blocks of each (kind, level, shard, language); rows come sorted by them."""

    def language(kind: int, level: int, lang: str | None, blocks: list) -> tuple[np.ndarray, np.ndarray, list]:
        width = 4 if kind == _CONTEXT else 1
        keys = np.concatenate([_keys(k) for k, _ in blocks])
        keys, values = summed(keys, np.concatenate([_wide(c).reshape(-1, width) for _, c in blocks]))
        rows = []
        if kind == _WINDOW:
            c = values[:, 0]
            if level > 1:
                shorter, ones = summed(keys & _U((1 << 8 * (level - 1)) - 1), np.ones((len(keys), 1), dtype=np.uint64))
                rows += _blocks(_WINDOW, level - 1, lang, shorter, ones, shards)
            stats = np.stack([c, c == 1, c == 2, c >= 3], axis=1).astype(np.uint64)
            rows += _blocks(_CONTEXT, level, lang, *summed(keys >> _U(8), stats), shards)
        return hashed(keys, lang), values, rows

    def save(kind: int, level: int, shard: int, parts: list) -> list:
        hashes, values = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(hashes)
        hashes, values = hashes[order], values[order]
        _save(folder, kind, level, shard, hashes, values if kind == _CONTEXT else values[:, 0])
        c = values[:, 0]
        kinds = [int((c == i).sum()) for i in (1, 2, 3, 4)] if kind == _WINDOW else [0] * 4
        return [(_SUMMARY, level, shard, None, bytes([kind]), np.array(kinds, dtype=np.int64).tobytes())]

    now, parts = None, []  # of a file
    lang, blocks = None, []  # of a language in it

    def close():
        hashes, values, rows = language(*now[:2], lang, blocks)
        parts.append((hashes, values))
        return rows

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] == _SUMMARY:
                yield _batch([row])
                continue
            if blocks and (row[:3] != now or row[3] != lang):
                rows = close()
                blocks = []
                if row[:3] != now:
                    rows += save(*now, parts)
                    parts.clear()
                if rows:
                    yield _batch(rows)
            now, lang = row[:3], row[3]
            blocks.append(row[4:])
    if blocks:
        yield _batch(close() + save(*now, parts))


class Model(NamedTuple):
    """Where the files lie, which there are, and the discounts by level."""

    folder: str
    order: int
    shards: int
    discounts: list[tuple[float, float, float]]
    files: frozenset[tuple[int, int, int]]  # (kind, level, shard)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Those of modified Kneser-Ney, kept within (0, count); halves where counts are missing."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = [i - (i + 1) * y * b / a if a else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), ratios))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, shards: int | None = None) -> Model:
    """Count the windows of all texts and write the model's files."""
    folder = mounted(fresh_path(docs.sparkSession, "byte-model"))
    os.makedirs(folder, exist_ok=True)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    rows = rows.mapInArrow(lambda b: _count(b, order, shards), _BLOCK)
    for _ in range(order + 1):  # the contexts of single bytes come last
        dealt = rows.repartition(shards, "shard").sortWithinPartitions("kind", "level", "shard", "lang")
        rows = dealt.mapInArrow(lambda b: _reduce(b, folder, shards), _BLOCK)
    kinds, files = np.zeros((order + 1, 4), dtype=np.int64), set()
    for row in rows.select("level", "shard", "keys", "counts").collect():  # one row per file
        kinds[row["level"]] += np.frombuffer(row["counts"], dtype=np.int64)
        files.add((row["keys"][0], row["level"], row["shard"]))
    return Model(folder, order, shards, [discounts(*map(int, kinds[i])) for i in range(1, order + 1)], frozenset(files))


# ---- scoring -----------------------------------------------------------------------


class Reader:
    """Costs of windows from the mapped files; windows met before come from a table."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[tuple[int, int, int], Shard] = {}
        self.known = np.zeros(1 << CACHE_BITS, dtype=np.uint64)
        self.costs = np.full(1 << CACHE_BITS, np.nan)

    def find(self, kind: int, level: int, hashes: np.ndarray, width: int = 1) -> np.ndarray:
        """Values (a column each) behind sorted hashes; zero where there is none."""
        out = np.zeros((len(hashes), width))
        shard = shard_of(hashes, self.model.shards)
        for s in np.unique(shard):
            key = (kind, level, int(s))
            if key not in self.model.files:
                continue
            if key not in self.files:
                self.files[key] = _map(self.model.folder, *key)
                if self.files[key] is None:
                    raise FileNotFoundError(f"the model's file {key} is missing in {self.model.folder}")
            file = self.files[key]
            own = slice(*np.searchsorted(shard, (s, s + 1)))
            at = np.minimum(np.searchsorted(file.hashes, hashes[own]), len(file.hashes) - 1)
            hit = file.hashes[at] == hashes[own]
            out[own][hit] = file.values[:, at[hit]].T
        return out

    def look_up(self, kind: int, level: int, keys: np.ndarray, lang: str | None, width: int = 1) -> np.ndarray:
        hashes, back = np.unique(hashed(keys, lang), return_inverse=True)
        return self.find(kind, level, hashes, width)[back]

    def probabilities(self, keys: np.ndarray, lang: str | None) -> np.ndarray:
        """Probability of the last byte of each window after the others."""
        p = None
        for level in range(1, self.model.order + 1):
            part = keys & _U((1 << 8 * level) - 1)
            count = self.look_up(_WINDOW, level, part, lang)[:, 0]
            stats = self.look_up(_CONTEXT, level, part >> _U(8), lang, 4)
            total, kinds = stats[:, 0], stats[:, 1:]
            if p is None:
                p = 1.0 / (kinds.sum(axis=1) + 1)  # distinct bytes of the language, and one
            d = self.model.discounts[level - 1]
            cut = np.choose(np.minimum(count, 3).astype(np.int64), (0.0, *d))
            base = np.where(total > 0, total, 1.0)
            p = np.where(total > 0, np.maximum(count - cut, 0) / base + (kinds @ np.array(d)) / base * p, p)
        return p

    def cost(self, keys: np.ndarray, lang: str | None) -> np.ndarray:
        """-log10 of the probabilities."""
        hashes = hashed(keys, lang)
        slot = (hashes >> _U(64 - CACHE_BITS)).astype(np.int64)
        costs = self.costs[slot]
        new = np.flatnonzero((self.known[slot] != hashes) | np.isnan(costs))
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            fresh = -np.log10(self.probabilities(distinct, lang))
            costs[new] = fresh[back]
            self.known[slot[new]], self.costs[slot[new]] = hashes[new], costs[new]
        return costs


# ---- base counts ---------------------------------------------------------------------


def _repeated(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three words that its text has twice; groups rise."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < 3:
        return out
    inside = groups[2:] == groups[:-2]
    three = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
    key = mix(three ^ mix(groups[:-2].astype(np.uint64) + _U(1)))
    _, back, n = np.unique(key[inside], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(inside)[n[back] > 1]
    for i in range(3):
        out[twice + i] = True
    return out


def _equal_earlier(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[int] = set()
    n = at = 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip(b" \t\x0b\x0c\r"):
            key = hash(line)
            n += key in seen
            seen.add(key)
        at = end + 1
    return n


def base_counts(texts: list[bytes], limit: int = LIMIT) -> np.ndarray:
    """A row of ``COUNTS`` for each text."""
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    open_words: list[np.ndarray] = []  # hashes of the words of a text in several buffers
    for buffer, pieces in buffers(texts, limit):
        starts, ends = word_slices(buffer)
        hashes = hash_slices(buffer, starts, ends)
        owner = owners(starts, pieces)
        text = np.array([p.text for p in pieces])
        n = np.bincount(text[owner], minlength=len(texts))
        out[:, 0] += n
        chars = (~_GAP[buffer]) & ((buffer & 0xC0) != 0x80)
        for column, marks in ((1, chars), (2, _SYMBOL[buffer])):
            sums = np.concatenate(([0], np.cumsum(marks)))
            out[:, column] += np.bincount(
                text, [sums[p.end] - sums[p.start] for p in pieces], minlength=len(texts)
            ).astype(np.int64)
        for i, p in enumerate(pieces):
            if not (p.first and p.last):
                open_words.append(hashes[owner == i])
                if p.last:
                    whole = np.concatenate(open_words)
                    open_words = []
                    out[p.text, 4] = _repeated(np.zeros(len(whole), dtype=np.int64), whole).sum()
        whole = np.array([p.first and p.last for p in pieces])[owner]
        repeated = _repeated(owner[whole], hashes[whole])
        out[:, 4] += np.bincount(text[owner[whole]], repeated, minlength=len(texts)).astype(np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            out[i, 3] = _equal_earlier(t)
    return out


# ---- the operator --------------------------------------------------------------------


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep: int) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    for batch in batches:
        n = batch.num_rows
        counts = np.zeros((n, len(COUNTS)), dtype=np.int64)
        cost, size = np.zeros(n), np.zeros(n)
        for lang, rows, texts in _by_language(batch, keep, keep + 1):
            counts[rows] = base_counts(texts)
            carry = b""
            for buffer, pieces in buffers(texts):
                number, keys, carry = windows(buffer, pieces, carry, model.order)
                cost[rows] += np.bincount(number, reader.cost(keys, lang), minlength=len(rows))
                size[rows] += np.bincount(number, minlength=len(rows))
        mean = pa.array(cost / np.maximum(size, 1), mask=size == 0)
        yield pa.record_batch(
            [*batch.columns[:keep], *(pa.array(c) for c in counts.T), mean], names=[*batch.schema.names[:keep], *COUNTS, "cost"],
        )


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns but the text, with the base counts and the cost by byte."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{lang}`").cast("string").alias("_lang"), text)
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]] + [f"{c} long" for c in COUNTS] + ["cost double"])
    return rows.mapInArrow(lambda b: _score(b, model, len(keep)), types)


def bands(scored: DataFrame, width: float = WIDTH, lang: str = "lang") -> DataFrame:
    """(lang, low, high): the costs of each language that are kept."""
    step = F.floor(F.col("cost") / STEP).cast("long").alias("_step")
    steps = scored.filter("cost IS NOT NULL").groupBy(F.col(lang).alias("lang"), step).agg(F.count("*").alias("_n"))
    # At most one row per language and step from here on.
    middle = steps.groupBy("lang").agg(F.percentile("_step", 0.5, F.col("_n")).alias("_middle"))
    apart = steps.withColumnRenamed("lang", "_lang").join(middle, F.col("_lang").eqNullSafe(F.col("lang")))
    spread = apart.groupBy("lang", "_middle").agg(F.percentile(F.abs(F.col("_step") - F.col("_middle")), 0.5, F.col("_n")).alias("_spread"))
    reach = F.lit(width * 1.4826) * F.greatest(F.col("_spread"), F.lit(1.0))
    return spread.select(
        "lang", ((F.col("_middle") - reach) * STEP).alias("low"), ((F.col("_middle") + 1 + reach) * STEP).alias("high"),
    )


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = WIDTH, order: int = ORDER) -> DataFrame:
    """All columns of ``docs`` but the text, the base counts, cost, base_failed and kept."""
    model = train(docs, text, lang, order)
    own = [c for c in docs.columns if c != text and c not in (*COUNTS, "cost", "base_failed", "kept")]
    scored = written(score(docs.select(*[F.col(f"`{c}`") for c in own], text), model, text, lang), "rule-counts")
    limits = bands(scored, width, lang).select(F.col("lang").alias("_lang"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("cost").between(F.col("_low"), F.col("_high")), F.lit(False))
    joined = scored.join(limits, F.col(f"`{lang}`").eqNullSafe(F.col("_lang")), "left")
    return joined.withColumns({"base_failed": failed, "kept": ~failed & inside}).drop("_lang", "_low", "_high")
