"""Secrets by fixed patterns and a linear-chain conditional random field.

Three patterns give the base spans. The field adds others: it tags the tokens of a text
as begin, inside or outside of a secret from the token's shape, its neighbours and
features of the whole file, and Viterbi decoding picks the best sequence of tags.

A token is a run of word bytes (letters, digits, ``+ / _ . -`` and everything beyond
ASCII) or a run of other visible bytes. Every feature is a small code, so the score of a
tag is a sum of table rows and a batch of texts is scored in a few array operations. Only
stretches that could hold a secret are decoded token by token: where "outside" leads by
more than any neighbour can make up, it is the best tag whatever stands beside it, and
the text falls into independent parts there, and the result is that of decoding it whole
(a text of over 2 MB: each 2 MB of it).

The field is trained on windows of at most ``SAMPLE`` documents (smallest seeded digest),
with invented secrets and look-alikes put into some of them; base spans are labelled too.

Defined results: null and empty texts have no spans. Repeated rows get equal spans. An
added span that meets a base span is dropped, so base spans always stay as they are.
Offsets count code points, ends are exclusive. Other columns pass through.
"""

from __future__ import annotations

import base64
import random
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import digest
from .words import buffers, hash_slices, hash_word

KINDS = ("assign", "access", "hex", "crf")
SAMPLE = 300
WINDOWS = 6  # of each sampled document
WINDOW_WORDS = 20
SEED = 42
MARK = "[SECRET]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
# Runs of these characters end where the class ends, so a length in the pattern changes no match.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Words that announce a secret.
CUES = (
    "password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "api-key", "access_key", "secret_key",
    "auth", "bearer", "credential", "credentials", "authorization", "auth_token", "access_token", "client_secret",
)

OUT, BEGIN, IN = range(3)
_NEVER = -1e6


# No match without one of these in the text's small letters.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, kinds as listed."""
    found, small = [], text.lower()
    if any(hint in small for hint in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


# ---- features ------------------------------------------------------------------

_CLASS = np.full(256, 2, dtype=np.uint8)  # 0 blank, 1 word, 2 other
_CLASS[[*range(0x09, 0x0E), 0x20]] = 0
_CLASS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.-", *range(0x80, 0x100)]] = 1
_KIND = np.zeros(256, dtype=np.uint8)  # bits: small, capital, digit, hex letter, mark, beyond ASCII
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[*b"0123456789"]] = 4
_KIND[[*b"+/_-."]] = 16
_KIND[0x80:] = 32
_PLAIN = np.zeros(256, dtype=np.uint8)  # letters outside a-f
_PLAIN[[*b"ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-.", *range(0x80, 0x100)]] = 1
_LENGTHS = np.array([2, 4, 6, 9, 12, 16, 20, 24, 32, 41])
_SIZES = (11 * 128, 11 * 8, 4 * 6, 5, 8, 4)  # codes of each feature


class Tokens(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    codes: list[np.ndarray]


_CUE_HASHES = np.sort(np.array([hash_word(c.encode()) for c in CUES], dtype=np.uint64))


def tokens(buffer: np.ndarray, piece_starts: np.ndarray) -> Tokens:
    """Tokens of a buffer and their feature codes."""
    kind = _CLASS[buffer]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    ends = np.concatenate((edge[1:], [len(buffer)]))
    visible = kind[edge] > 0
    starts, ends, is_word = edge[visible], ends[visible], kind[edge[visible]] == 1
    n = len(starts)
    piece = np.searchsorted(piece_starts, starts, side="right") - 1
    if not n:
        return Tokens(starts, ends, piece, [np.zeros(0, dtype=np.int64)] * len(_SIZES))
    size = ends - starts
    binned = np.digitize(size, _LENGTHS)
    cover = np.stack([starts, ends], axis=1).ravel()
    at = buffer.copy()
    at = np.append(at, 32).astype(np.uint8)
    bits = np.bitwise_or.reduceat(_KIND[at], cover)[0::2].astype(np.int64)
    plain = np.bitwise_or.reduceat(_PLAIN[at], cover)[0::2].astype(np.int64)
    digit = (_KIND[at] == 4).astype(np.int32)
    flips = np.concatenate(([0], np.cumsum(digit[1:] != digit[:-1])))
    changes = np.minimum(flips[ends - 1] - flips[starts], 7)
    # 6 bits of kinds (hex letters are the absence of plain ones) and one for words.
    shape = binned * 128 + (bits & 7) + ((bits >> 4) & 3) * 8 + plain * 32 + is_word * 64
    mixing = binned * 8 + changes

    cue = np.zeros(n, dtype=bool)
    maybe = np.flatnonzero(is_word & (size >= 3) & (size <= 14))
    low = buffer | (((buffer >= 65) & (buffer <= 90)).astype(np.uint8) << 5)
    hashes = hash_slices(low, starts[maybe], ends[maybe])
    place = np.minimum(np.searchsorted(_CUE_HASHES, hashes), len(_CUE_HASHES) - 1)
    cue[maybe] = _CUE_HASHES[place] == hashes

    def shifted(values, by, default):
        out = np.full(n, default, dtype=np.int64)
        if by > 0:
            out[by:] = np.where(piece[by:] == piece[:-by], values[:-by], default)
        else:
            out[:by] = np.where(piece[:by] == piece[-by:], values[-by:], default)
        return out

    first = buffer[starts]
    last = buffer[ends - 1]
    sign = np.zeros(n, dtype=np.int64)  # of other tokens: assignment, quote, rest
    is_sign = ~is_word
    sign[is_sign] = 3
    sign[is_sign & ((last == 34) | (last == 39))] = 2
    sign[is_sign & ((first == 61) | (first == 58) | (last == 61) | (last == 58))] = 1
    sign[is_sign & ((first == 61) | (first == 58)) & ((last == 34) | (last == 39))] = 4
    near = np.zeros(n, dtype=np.int64)
    for by in (3, 2, 1):
        near[shifted(cue, by, 0) > 0] = by
    left = near * 6 + shifted(sign, 1, 5)
    right = shifted(np.where(is_word, 0, np.where((first == 34) | (first == 39), 1, 2)), -1, 3)
    own = cue * 1 + 2 * ((size >= 12) & (buffer[starts] == 65) & (at[np.minimum(starts + 1, len(buffer))] == 75))
    # The file: share of tokens that are not words, and how long its words are.
    count = np.bincount(piece, minlength=len(piece_starts))
    signs = np.bincount(piece[is_sign], minlength=len(piece_starts))
    bytes_of = np.bincount(piece, size, minlength=len(piece_starts))
    share = np.digitize(signs / np.maximum(count, 1), [0.02, 0.1, 0.3])
    average = (bytes_of / np.maximum(count, 1) > 7).astype(np.int64)
    return Tokens(starts, ends, piece, [shape, mixing, left, right, (share * 2 + average)[piece], own])


# ---- the field -----------------------------------------------------------------


class Field(NamedTuple):
    """Tables of scores: one (codes x 3) per feature, transitions, and the first tag."""

    tables: list[np.ndarray]
    moves: np.ndarray
    first: np.ndarray


def emissions(field: Field, codes: list[np.ndarray]) -> np.ndarray:
    return sum((table[code] for table, code in zip(field.tables, codes)), np.zeros((len(codes[0]), 3)))


def viterbi(field: Field, scores: np.ndarray, begins: bool) -> np.ndarray:
    """Best tags of one stretch; ``begins``: it starts a text, else it follows "outside"."""
    best = scores[0] + (field.first if begins else field.moves[OUT])
    back = np.zeros((len(scores), 3), dtype=np.int64)
    for t in range(1, len(scores)):
        total = best[:, None] + field.moves
        back[t] = total.argmax(0)
        best = total.max(0) + scores[t]
    tags = np.empty(len(scores), dtype=np.int64)
    tags[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def decode(field: Field, scores: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Best tags of all texts of a buffer."""
    n = len(scores)
    tags = np.zeros(n, dtype=np.int64)
    if not n:
        return tags
    opens = np.concatenate(([True], piece[1:] != piece[:-1]))
    allowed = field.moves[field.moves > _NEVER / 2]
    reach = 3 * max(allowed.max() - allowed.min(), 0.0) + np.ptp(field.first[:2])
    # Turning a tag to "outside" may turn the next "inside" to "begin".
    following = np.zeros(n)
    following[:-1] = np.where(opens[1:], 0.0, np.maximum(scores[1:, IN] - scores[1:, BEGIN], 0.0))
    sure = scores[:, OUT] - scores[:, 1:].max(1) > reach + following
    unsure = ~sure
    begins = unsure & (opens | np.concatenate(([True], sure[:-1])))
    stops = unsure & np.concatenate((sure[1:] | opens[1:], [True]))
    for a, b in zip(np.flatnonzero(begins), np.flatnonzero(stops) + 1):
        stretch = scores[a:b]
        if b < n and not opens[b]:  # "outside" follows, from which no tag is barred
            stretch = stretch.copy()
            stretch[-1] += field.moves[:, OUT]
        tags[a:b] = viterbi(field, stretch, bool(opens[a]))
    return tags


def fit(sequences: list[tuple[list[np.ndarray], np.ndarray]], rounds: int = 80, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a penalty, by Adam over all windows at once."""
    length = max((len(t) for _, t in sequences), default=1)
    n = len(sequences)
    tags = np.zeros((n, length), dtype=np.int64)
    mask = np.zeros((n, length), dtype=bool)
    codes = [np.zeros((n, length), dtype=np.int64) for _ in _SIZES]
    for i, (c, t) in enumerate(sequences):
        tags[i, : len(t)], mask[i, : len(t)] = t, True
        for f, values in enumerate(c):
            codes[f][i, : len(t)] = values
    sizes = [s * 3 for s in _SIZES] + [9, 3]
    cuts = np.cumsum([0, *sizes])
    barred = np.zeros((3, 3))
    barred[OUT, IN] = _NEVER
    start_barred = np.array([0.0, 0.0, _NEVER])
    w, m, v = (np.zeros(cuts[-1]) for _ in range(3))

    def unpack(w):
        parts = [w[cuts[i] : cuts[i + 1]] for i in range(len(sizes))]
        return [p.reshape(-1, 3) for p in parts[:-2]], parts[-2].reshape(3, 3) + barred, parts[-1] + start_barred

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    one = np.eye(3)
    for step in range(1, rounds + 1):
        tables, moves, first = unpack(w)
        e = sum(t[c] for t, c in zip(tables, codes))
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, length):
            new = lse(alpha[:, t - 1][:, :, None] + moves, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t][:, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = lse(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1][:, None], new, 0.0)
        total = lse(alpha[:, -1], 1)
        each = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        residual = (one[tags] * mask[:, :, None]) - each
        gradient = [
            np.stack([np.bincount(c[mask], residual[:, :, k][mask], minlength=s) for k in range(3)], 1).ravel()
            for c, s in zip(codes, _SIZES)
        ]
        pair = np.exp(
            alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * mask[:, 1:, None, None]
        seen = np.einsum("ntj,ntk->jk", one[tags[:, :-1]] * mask[:, 1:, None], one[tags[:, 1:]] * mask[:, 1:, None])
        gradient += [(seen - pair.sum((0, 1))).ravel(), (one[tags[:, 0]] - each[:, 0]).sum(0)]
        g = np.concatenate(gradient) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    tables, moves, first = unpack(w)
    return Field(list(tables), moves, first)


# ---- training data ---------------------------------------------------------------


def _invented(draw: random.Random) -> tuple[str, str]:
    """(text, secret inside it) of one kind of secret."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rand = lambda n, chars=letters: "".join(draw.choice(chars) for _ in range(n))
    secret = draw.choice((
        lambda: rand(draw.randint(16, 48)), lambda: rand(draw.choice((24, 32, 40, 64)), "0123456789abcdef"),
        lambda: "AKIA" + rand(16, letters[26:]), lambda: "ghp_" + rand(36), lambda: "sk_live_" + rand(24),
        lambda: base64.b64encode(bytes(draw.randrange(256) for _ in range(draw.choice((24, 33, 48))))).decode().rstrip("="),
        lambda: "-".join(rand(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)),
        lambda: ".".join(("eyJ" + rand(17), rand(40), rand(43))),
    ))()
    cue = draw.choice(CUES)
    cue = draw.choice((cue, cue.upper(), cue.capitalize()))
    form = draw.choice(("{c} = \"{s}\"", "{c}={s}", "{c}: {s}", "{c}: '{s}'", "{c} {s}", "\"{c}\": \"{s}\"", "{s}", "{c} is {s}"))
    return form.format(c=cue, s=secret), secret


def _harmless(draw: random.Random) -> str:
    """Something that looks like a secret and is none."""
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    return draw.choice((
        lambda: number(16), lambda: ".".join(str(draw.randrange(256)) for _ in range(4)),
        lambda: f"{draw.choice(CUES)} was changed", lambda: f"the {draw.choice(CUES)}: see below",
        lambda: f"user{number(2)}@mail{number(1)}.example.com", lambda: f"https://www.example.org/{number(3)}/index.html?page={number(2)}",
        lambda: f"2{number(3)}-0{number(1)[0]}-1{number(1)[0]}T12:{number(2)}:{number(2)}", lambda: f"+{number(2)} {number(3)} {number(7)}",
        lambda: f"v{number(1)}.{number(2)}.{number(1)}", lambda: "x" * draw.randint(12, 30), lambda: f"ISBN 978-{number(1)}-{number(5)}-{number(3)}-{number(1)}",
    ))()


def windows(text: str, seed: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """Labelled token sequences from one text."""
    draw = random.Random(seed)
    words = text.split()
    out = []
    for k in range(WINDOWS):
        at = draw.randrange(max(1, len(words) - WINDOW_WORDS + 1))
        part = words[at : at + WINDOW_WORDS]
        secret = None
        if k % 3 != 2:
            place = draw.randint(0, len(part))
            if k % 3:
                added, secret = _invented(draw)
            else:
                added = _harmless(draw)
            part = part[:place] + [added] + part[place:]
        whole = " ".join(part)
        data = whole.encode("utf-8", "replace")
        if not data.strip():
            continue
        got = tokens(np.frombuffer(data, dtype=np.uint8), np.array([0]))
        marks = np.zeros(len(data) + 1, dtype=bool)
        spans = [(len(whole[:a].encode("utf-8", "replace")), len(whole[:b].encode("utf-8", "replace")), kind, whole[a:b])
                 for a, b, kind in base_spans(whole)]
        for a, b, kind, said in spans:
            if kind == "assign":
                a += len(_ASSIGN.match(said).group(0)) - len(_ASSIGN.match(said).group(2))
            marks[a:b] = True
        if secret is not None:
            a = data.find(secret.encode())
            marks[a : a + len(secret)] = True
        inside = marks[got.starts]
        tags = np.where(inside, np.where(np.concatenate(([False], inside[:-1])), IN, BEGIN), OUT)
        out.append((got.codes, tags))
    return out


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Field:
    """Train on windows of at most ``sample`` documents of ``docs`` (doc_id, text)."""
    chosen = docs.select("doc_id").withColumn("_order", digest(seed, "doc_id")).orderBy("_order", "doc_id").limit(sample)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id")).distinct())  # at most ``sample`` rows
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for codes, tags in windows(text or "", seed * 1_000_003 + int(doc_id)):
                    rows.append((int(doc_id), np.stack([*codes, tags]).astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "window"])

    got = sorted((r["doc_id"], r["window"]) for r in texts.mapInPandas(cut, "doc_id long, window binary").collect())
    if not got:  # no text to learn from: invented windows alone
        return fit(windows(" ".join(["plain"] * 40), seed))
    arrays = [np.frombuffer(w, dtype=np.int32).reshape(len(_SIZES) + 1, -1).astype(np.int64) for _, w in got]
    return fit([(list(a[:-1]), a[-1]) for a in arrays])


# ---- scan ------------------------------------------------------------------------


def added_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Spans of the field for each text, in code points."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    encoded = [t.encode("utf-8", "replace") for t in texts]
    base = [0] * len(texts)  # bytes of a long text that earlier buffers held
    for buffer, pieces in buffers(encoded):
        got = tokens(buffer, np.array([p.start for p in pieces]))
        tags = decode(field, emissions(field, got.codes), got.piece)
        begins = np.flatnonzero(tags == BEGIN)
        if len(begins):
            stops = np.flatnonzero((tags[:-1] != OUT) & ((tags[1:] != IN) | (got.piece[1:] != got.piece[:-1])))
            stops = np.append(stops, len(tags) - 1)
            ends = stops[np.searchsorted(stops, begins)]
            for b, e in zip(begins, ends):
                p = pieces[got.piece[b]]
                offset = base[p.text] - p.start
                start, end = int(got.starts[b]) + offset, int(got.ends[e]) + offset
                data = encoded[p.text]
                at = len(data[:start].decode("utf-8", "replace"))
                found[p.text].append((at, at + len(data[start:end].decode("utf-8", "replace"))))
        for p in pieces:
            base[p.text] += p.end - p.start
    return found


def all_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Base spans and added ones of each text, by start, then kind as listed."""
    out = []
    for text, extra in zip(texts, added_spans(field, texts)):
        base = base_spans(text)
        extra = [(a, b, "crf") for a, b in extra if not any(a < e and s < b for s, e, _ in base)]
        out.append(sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))
    return out


_PER_CALL = 256


def spans(text: Column, field: Field) -> Column:
    """Spans of a text: array of (kind, start, end)."""

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), _PER_CALL):
            part = ["" if t is None else t for t in texts.iloc[i : i + _PER_CALL]]
            out += [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in all_spans(field, part)]
        return pd.Series(out)

    return run(text)


def redact_text(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by ``MARK``."""
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced; ``length`` follows where a text changed. No row goes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), _PER_CALL):
            part = list(texts.iloc[i : i + _PER_CALL])
            found = all_spans(field, ["" if t is None else t for t in part])
            out += [None if t is None else redact_text(t, s) if s else t for t, s in zip(part, found)]
        return pd.Series(out, dtype=object)

    columns = docs.columns
    new = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), run(F.col(text)).alias("new"))
    kept = []
    for c in columns:
        own = F.col("row").getField(c)
        if c == text:
            own = F.col("new")
        elif c == length:
            own = F.when(F.col("new").eqNullSafe(F.col("row").getField(text)), own).otherwise(
                F.length("new").cast(docs.schema[c].dataType)
            )
        kept.append(own.alias(c))
    return new.select(*kept)
