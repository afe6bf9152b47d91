"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and read by mapping.

Counting. A task cuts its texts to words in array operations and sums n-grams before
anything is shuffled; a shuffle row is a block of n-grams for one shard. An n-gram's shard
comes from its own hash, so a word that is a third of the corpus is spread like any
other, and the number of shards follows from the bytes of text. A shard's task sums its
blocks, writes a file of sorted hashes and counts, and passes two kinds of blocks on: the
shorter n-grams that its n-grams end in, one count each (continuation counts), and the
totals of their contexts. Levels follow from the longest to single words, in one job whose
only result on the driver is a row of counts of counts per shard and level.

Storage. A file holds sorted 64-bit hashes and their values; it is written aside and
renamed, so a repeated task leaves the same file. The folder is the shared one of the
session, which must be mounted at the same path on all machines.

Scoring. Every worker maps the files to memory and looks up the sorted n-grams of a batch
of texts, so a worker holds no copy of the model; pages are shared and read when needed.

The probability of a word after a context is
``max(c - D(c), 0) / total + (D1 n1 + D2 n2 + D3 n3) / total * p(word | shorter context)``
with three discounts per level from the counts of counts; single words fall back to
1 / (V + 1). Texts start from a start mark, which is never predicted, and end with an end
mark, which is. A context that was never seen leaves the word to the shorter one.

Defined results: null and empty texts are the end mark alone. Null ids count as training
rows. Repeated rows are counted each time. Without training rows every score comes from
the last fallback. Other columns are not looked at. Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path
from .words import Piece, buffers, hash_slices, lower, mix, word_slices

ORDER = 2
SHARD_BYTES = 12 << 20  # text bytes behind one shard
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_U = np.uint64
_GRAM, _CONTEXT, _PLAIN, _SUMMARY = range(4)
_BLOCK = "kind int, level int, shard int, keys binary, counts binary"
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
])


class Model(NamedTuple):
    """Where the files lie, and the few numbers that every score needs."""

    folder: str
    order: int
    shards: int
    discounts: list[tuple[float, float, float]]  # by level, single words first
    word_total: int  # distinct n-grams below the single words
    word_kinds: tuple[int, int, int]  # single words with one, two, more of them
    vocabulary: int  # distinct training tokens
    tokens: int  # training tokens


# ---- n-grams -------------------------------------------------------------------


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes."""
    h = np.zeros(len(words), dtype=np.uint64)
    for column in range(words.shape[1]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + words[:, column])
    return h


def token_rows(pieces: list[Piece], starts: np.ndarray, hashes: np.ndarray, carry: np.ndarray, order: int):
    """N-grams that end at each token, the end mark of finished texts included.

    ``carry`` has the last words of a text whose earlier part was in another buffer.
    Returns (text of each token, n-grams, words to carry on).
    """
    at = np.array([p.start for p in pieces])
    bounds = np.searchsorted(starts, np.append(at, np.iinfo(np.int64).max))
    tokens, texts, lead = [], [], order - 1
    for i, p in enumerate(pieces):
        own = hashes[bounds[i] : bounds[i + 1]]
        before = np.full(lead, START) if p.first else carry
        tokens += [before, own] + ([np.array([END])] if p.last else [])
        texts.append(len(own) + p.last)
        if not p.last:
            carry = np.concatenate((before, own))[len(before) + len(own) - lead :]
    flat = np.concatenate(tokens)
    counts = np.array(texts)
    number = np.repeat(np.array([p.text for p in pieces]), counts)
    # The token of piece i stands after all its own lead marks.
    index = np.arange(len(number)) + np.repeat(np.arange(1, len(pieces) + 1) * lead, counts)
    return number, np.stack([flat[index - lead + j] for j in range(order)], axis=1), carry


def summed(words: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of their hashes: (hash, words, count); no counts mean ones.

    Only the rows that stay are copied.
    """
    h = gram_hash(words)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
    if counts is None:
        n = np.diff(first, append=len(h)).astype(np.uint64)
    else:
        n = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return h[first], words[order[first]], n


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hashes, so sorted hashes give sorted shards."""
    return ((hashes >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the smallest width that holds them; the first byte says which."""
    top = int(counts.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.uint64)


def _columns(words: np.ndarray) -> bytes:
    """Word hashes column by column, all but the last as differences, which compress."""
    out = []
    for c in range(words.shape[1]):
        column = words[:, c]
        out.append(np.diff(column, prepend=_U(0)) if c < words.shape[1] - 1 else column)
    return b"".join(np.ascontiguousarray(c).tobytes() for c in out)


def _rows(data: bytes, width: int) -> np.ndarray:
    columns = np.frombuffer(data, dtype=np.uint64).reshape(width, -1)
    return np.stack([np.cumsum(c, dtype=np.uint64) if i < width - 1 else c for i, c in enumerate(columns)], axis=1)


def _blocks(kind: int, level: int, hashes: np.ndarray, words: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows of blocks by shard; ``counts`` may have several columns."""
    shard = shard_of(hashes, shards)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in range(shards):
        part = slice(cuts[s], cuts[s + 1])
        if cuts[s] == cuts[s + 1]:
            continue
        w, c = words[part], counts[part]
        by_words = np.lexsort(w.T[::-1])  # equal leading words together: their differences are zero
        w, c = w[by_words], c[by_words]
        yield kind, level, s, _columns(w), _narrow(c.ravel())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


_HOLD = 3 << 20  # n-grams a task sums before it passes them on


def _count(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks of n-grams and of plain tokens from rows of text."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        words = np.concatenate(held)
        held.clear()
        h, w, c = summed(words, None)
        del words
        rows = list(_blocks(_GRAM, order, h, w, c, shards))
        h, w, c = summed(w[:, -1:], c)
        return _batch(rows + list(_blocks(_PLAIN, 1, h, w, c, shards)))

    for batch in batches:
        texts = (lower(t) for t in batch.column(0).to_pylist())
        carry = np.zeros(0, dtype=np.uint64)
        for buffer, pieces in buffers(texts):
            starts, ends = word_slices(buffer)
            _, grams, carry = token_rows(pieces, starts, hash_slices(buffer, starts, ends), carry, order)
            held.append(grams)
            size += len(grams)
            if size >= _HOLD:
                yield flush()
                size = 0
    if held:
        yield flush()


# ---- shard files -----------------------------------------------------------------


def _path(folder: str, kind: int, level: int, shard: int) -> str:
    return os.path.join(folder, f"{kind}-{level}-{shard}")


def _save(folder: str, kind: int, level: int, shard: int, hashes: np.ndarray, values: np.ndarray) -> None:
    """Write a file aside, then rename it."""
    path = _path(folder, kind, level, shard)
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        width = 1 if values.ndim == 1 else values.shape[1]
        flat = np.ascontiguousarray(values.T).ravel() if width > 1 else values
        data = _narrow(flat)
        f.write(np.array([len(hashes), width, data[0]], dtype=np.uint64).tobytes())
        f.write(hashes.tobytes())
        f.write(data[1:])
    os.replace(aside, path)


class Shard(NamedTuple):
    hashes: np.ndarray
    values: np.ndarray  # a row of values per column


def _map(folder: str, kind: int, level: int, shard: int) -> Shard | None:
    path = _path(folder, kind, level, shard)
    if not os.path.exists(path):  # a shard that got nothing
        return None
    data = np.memmap(path, dtype=np.uint8, mode="r")
    n, width, size = (int(x) for x in data[:24].view(np.uint64))
    hashes = np.frombuffer(data, dtype=np.uint64, count=n, offset=24)
    values = np.frombuffer(data, dtype=f"<u{size}", count=n * width, offset=24 + 8 * n)
    return Shard(hashes, values.reshape(width, n))


def _reduce(batches: Iterator[pa.RecordBatch], folder: str, order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Sum the blocks of each (kind, level, shard); rows come sorted by them."""

    def finish(kind, level, shard, blocks):
        width = 1 if kind == _PLAIN else level if kind == _GRAM else level - 1
        words = np.concatenate([_rows(k, width) for k, _ in blocks])
        if kind == _CONTEXT:
            values = np.concatenate([_wide(c).reshape(-1, 4) for _, c in blocks])
            h = gram_hash(words)
            by = np.argsort(h, kind="stable")
            h, values = h[by], values[by]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            _save(folder, kind, level, shard, h[first], np.add.reduceat(values, first, axis=0))
            return []
        h, w, c = summed(words, np.concatenate([_wide(c) for _, c in blocks]))
        _save(folder, kind, level, shard, h, c)
        kinds = [int((c == i).sum()) for i in (1, 2, 3, 4)] + [int((c >= 3).sum()), int(c.sum()), len(c)]
        rows = [(_SUMMARY, level if kind == _GRAM else 0, shard, b"", np.array(kinds, dtype=np.int64).tobytes())]
        if kind == _GRAM and level > 1:
            sh, sw, sc = summed(w[:, 1:], None)
            rows += _blocks(_GRAM, level - 1, sh, sw, sc, shards)
            ch = gram_hash(w[:, :-1])
            by = np.argsort(ch, kind="stable")
            ch, cw, cc = ch[by], w[by, :-1], c[by]
            first = np.flatnonzero(np.concatenate(([True], ch[1:] != ch[:-1])))
            stats = np.add.reduceat(np.stack([cc, cc == 1, cc == 2, cc >= 3], axis=1).astype(np.uint64), first, axis=0)
            rows += _blocks(_CONTEXT, level, ch[first], cw[first], stats, shards)
        return rows

    now, blocks = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] == _SUMMARY:
                yield _batch([row])
                continue
            if row[:3] != now:
                if blocks and (rows := finish(*now, blocks)):
                    yield _batch(rows)
                now, blocks = row[:3], []
            blocks.append(row[3:])
    if blocks and (rows := finish(*now, blocks)):
        yield _batch(rows)


def mounted(path: str) -> str:
    """A folder's plain path; mapping needs one that all machines mount."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{path}: n-gram files are mapped to memory, so the folder must be a mounted one")
    return "/" + rest.lstrip("/")


def train(texts: DataFrame, order: int = ORDER, folder: str | None = None, shards: int | None = None) -> Model:
    """Count the texts (one string column) and write the model's files."""
    spark = texts.sparkSession
    folder = mounted(folder or fresh_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    column = texts.columns[0]
    if shards is None:
        size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    rows = texts.select(column).mapInArrow(lambda b: _count(b, order, shards), _BLOCK)
    for _ in range(order):
        dealt = rows.repartition(shards, "kind", "level", "shard").sortWithinPartitions("kind", "level", "shard")
        rows = dealt.mapInArrow(lambda b: _reduce(b, folder, order, shards), _BLOCK)
    kinds = {i: np.zeros(7, dtype=np.int64) for i in range(order + 1)}
    for row in rows.select("level", "counts").collect():  # one row per shard and level
        kinds[row["level"]] += np.frombuffer(row["counts"], dtype=np.int64)
    discounts = []
    for level in range(1, order + 1):
        n1, n2, n3, n4 = (max(int(x), 0) for x in kinds[level][:4])
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        ratios = [i - (i + 1) * y * b / a if a else i * 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discounts.append(tuple(min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), ratios)))
    one = kinds[1]
    return Model(
        folder, order, shards, discounts, int(one[5]), (int(one[0]), int(one[1]), int(one[4])),
        int(kinds[0][6]), int(kinds[0][5]),
    )


# ---- scoring -----------------------------------------------------------------------


class Reader:
    """Look-ups in the mapped files of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[tuple[int, int, int], Shard | None] = {}

    def find(self, kind: int, level: int, words: np.ndarray, width: int = 1) -> np.ndarray:
        """Values (a column each) of the n-grams; zero where there is none."""
        h, back = np.unique(gram_hash(words), return_inverse=True)
        out = np.zeros((len(h), width))
        shard = shard_of(h, self.model.shards)
        cuts = np.searchsorted(shard, np.arange(self.model.shards + 1))
        for s in np.unique(shard):
            key = (kind, level, int(s))
            if key not in self.files:
                self.files[key] = _map(self.model.folder, *key)
            file = self.files[key]
            if file is None:
                continue
            part = slice(cuts[s], cuts[s + 1])
            at = np.minimum(np.searchsorted(file.hashes, h[part]), len(file.hashes) - 1)
            hit = file.hashes[at] == h[part]
            out[part][hit] = file.values[:, at[hit]].T
        return out[back]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Probability of the last word of each n-gram after the words before it."""
        m = self.model
        p = np.full(len(grams), 1.0 / (m.vocabulary + 1))
        for level in range(1, m.order + 1):
            part = grams[:, m.order - level :]
            count = self.find(_GRAM, level, part)[:, 0]
            if level == 1:
                total = np.full(len(grams), float(m.word_total))
                kinds = np.broadcast_to(np.array(m.word_kinds, dtype=float), (len(grams), 3))
            else:
                stats = self.find(_CONTEXT, level, part[:, :-1], 4)
                total, kinds = stats[:, 0], stats[:, 1:]
            d = m.discounts[level - 1]
            cut = np.choose(np.minimum(count, 3).astype(np.int64), (0.0, *d))
            seen = total > 0
            base = np.where(seen, total, 1.0)
            p = np.where(seen, np.maximum(count - cut, 0) / base + (kinds @ np.array(d)) / base * p, p)
        return p


def _score(batches: Iterator[pa.RecordBatch], model: Model, columns: int) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    n_total, v = model.tokens, model.vocabulary
    for batch in batches:
        n = batch.num_rows
        out = np.zeros((4, n))
        carry = np.zeros(0, dtype=np.uint64)
        for buffer, pieces in buffers(lower(t) for t in batch.column(columns).to_pylist()):
            starts, ends = word_slices(buffer)
            number, grams, carry = token_rows(pieces, starts, hash_slices(buffer, starts, ends), carry, model.order)
            plain = reader.find(_PLAIN, 1, grams[:, -1:])[:, 0]
            for row, values in enumerate((
                np.ones(len(number)), plain > 0, np.log10((plain + 0.5) / (n_total + 0.5 * (v + 1))),
                np.log10(reader.probabilities(grams)),
            )):
                out[row] += np.bincount(number, values, minlength=n)
        yield pa.record_batch(
            [*(batch.column(i) for i in range(columns)), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)),
             pa.array(out[2]), pa.array(out[3])],
            names=[*batch.schema.names[:columns], "n_tokens", "n_known", "base_score", "score"],
        )


def score(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, with n_tokens, n_known, base_score, score (log10)."""
    keep = [c for c in rows.columns if c != text]
    selected = rows.select(*[F.col(f"`{c}`") for c in keep], text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in selected.schema.fields[:-1])
    schema = (types + ", " if types else "") + "n_tokens long, n_known long, base_score double, score double"
    return selected.mapInArrow(lambda b: _score(b, model, len(keep)), schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of all scored rows: one row."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
