"""Cheapest repair of conversations by tables of symbol blocks.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept (cost 0), given the
role user or assistant (2) or deleted (3, required for blank and repeated rows), empty rows
of user or assistant are inserted anywhere (2), and a cut-off row that stays adds 1. Where an
edit leads follows from the place in that pattern, so a string of edits ``K R D I`` names the
whole repair. Of all cheapest ones the least string by code point is taken.

A row is one of nine symbols. The costs of the rest of a conversation, by place in the
pattern, form a vector; less its least entry there are few such vectors, because inserting
reaches every place. For each vector and each block of ``BLOCK`` symbols a table holds the
vector before the block, the cost between, and the place behind it for each place before it.
A conversation is read by blocks from its end to its start, one look-up each, and the vector
behind each block is kept. Tracing goes from the start: a block is expanded backward from its
kept vector to the vectors of its rows, then each row takes the least edit that stays on a
cheapest way. Expansions are remembered by vector, block and place.

At size. Equal rows are counted before they are sorted, so copies are one row with a number.
Rows are sorted by ranges of (conversation, turn, tie), which cut a conversation of any size
over many tasks. A task repairs the conversations that lie inside it. Of those at its edges,
and of those above ``CHUNK_BYTES``, it passes on segments: the effect of the segment on every
vector and place, composed by the same tables, and its rows in chunks. Effects are joined per
conversation, then all segments are traced at once. Only the hash over a whole
conversation, sequential by nature, streams through one task.

Defined results: null roles and texts are one blank; null ids are one conversation; null turns
come first. Rows of one turn are ordered by the MD5 of role length, role and text. Repeated
rows count as often as they occur; all but the first are duplicates. A role whose initial is
not s, u or a, the empty one included, is never kept. Texts are looked at whole. Empty tables
give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import lookup_join
from ..session import written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
BLOCK = 4
CHUNK_BYTES = 8 << 20
PART_BYTES = 64 << 20
_BLANKS = " \t\n\x0b\x0c\r"

# Places in the pattern: nothing yet, after s, after u, after a.
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
_NEXT = (2, 2, 3, 2)  # where the role that is due leads
_DUE = ("user", "user", "assistant", "user")
_END = (0, 4, 2, 0)  # cost of what must still be inserted
_INITIALS = "suax"
_MUST_GO, _PAD = 8, 9  # symbols 0 to 3 by initial, 4 to 7 the same cut off
_SYMBOLS = 10

RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


# ---- tables ------------------------------------------------------------------


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs by place before a row, given those behind it."""
    if symbol == _PAD:
        return after
    cut = CUT_OFF if 4 <= symbol < _MUST_GO else 0
    costs = []
    for place in range(4):
        ways = [DELETE + after[place]]
        if symbol != _MUST_GO:
            ways.append(REROLE + cut + after[_NEXT[place]])
            kept = _KEPT[_INITIALS[symbol % 4]][place]
            if kept is not None:
                ways.append(KEEP + cut + after[kept])
        costs.append(min(ways))
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[place]]) for place, c in enumerate(costs)]
    return tuple(costs)


def least_edits(after: tuple[int, ...], symbol: int, place: int) -> tuple[str, int]:
    """The least edits up to and including a row that stay on a cheapest way; the place behind."""
    if symbol == _PAD:
        return "", place
    costs, edits = before(after, symbol), ""
    cut = CUT_OFF if 4 <= symbol < _MUST_GO else 0
    while True:  # in the order D, I, K, R
        if DELETE + after[place] == costs[place]:
            return edits + "D", place
        if INSERT + costs[_NEXT[place]] == costs[place]:
            edits, place = edits + "I", _NEXT[place]
            continue
        kept = None if symbol == _MUST_GO else _KEPT[_INITIALS[symbol % 4]][place]
        if kept is not None and KEEP + cut + after[kept] == costs[place]:
            return edits + "K", kept
        return edits + "R", _NEXT[place]


def last_edits(place: int) -> str:
    """What is inserted behind the last row."""
    edits = ""
    while _END[place]:
        edits, place = edits + "I", _NEXT[place]
    return edits


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]  # normalised; the first one is the end's
    one: np.ndarray  # vector, symbol -> vector before
    vector: np.ndarray  # vector, block -> vector before
    cost: np.ndarray  # vector, block -> cost taken out
    place: np.ndarray  # vector, block, place -> place behind


@lru_cache(None)
def tables(block: int = BLOCK) -> Tables:
    """All normalised vectors that occur and the transitions of all blocks."""
    vectors, at = [_END], {_END: 0}
    one, cost, place = [], [], []
    for vector in vectors:  # grows while it is read
        row = []
        for symbol in range(_SYMBOLS):
            costs = before(vector, symbol)
            low = min(costs)
            new = tuple(c - low for c in costs)
            if new not in at:
                at[new] = len(vectors)
                vectors.append(new)
            row.append((at[new], low, [least_edits(vector, symbol, p)[1] for p in range(4)]))
        one.append([r[0] for r in row])
        cost.append([r[1] for r in row])
        place.append([r[2] for r in row])
    one, cost, place = np.array(one), np.array(cost), np.array(place)
    v, c, p = one, cost, place
    for _ in range(block - 1):  # put a symbol before all shorter blocks
        n = len(vectors)
        c = (c[:, None, :] + cost[v].transpose(0, 2, 1)).reshape(n, -1)
        first = place[v].transpose(0, 2, 1, 3)  # vector, symbol, shorter block, place
        p = np.take_along_axis(np.broadcast_to(p[:, None], first.shape), first, axis=3).reshape(n, -1, 4)
        v = one[v].transpose(0, 2, 1).reshape(n, -1)
    return Tables(vectors, one, v, c, p)


def blocks_of(symbols: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Numbers of the blocks of a sequence, filled up at its end."""
    padded = np.full(-(-len(symbols) // block) * block, _PAD, dtype=np.int64)
    padded[: len(symbols)] = symbols
    return padded.reshape(-1, block) @ _SYMBOLS ** np.arange(block - 1, -1, -1)


@lru_cache(1 << 18)
def _expand(vector: int, block: int, place: int, length: int) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Edits of each row of a block before ``vector``, from ``place`` on, and the places behind."""
    t = tables(length)
    symbols = [block // _SYMBOLS**i % _SYMBOLS for i in range(length - 1, -1, -1)]
    behind = [vector]
    for symbol in reversed(symbols):
        behind.append(int(t.one[behind[-1], symbol]))
    edits, places = [], []
    for symbol, v in zip(symbols, behind[-2::-1]):
        row, place = least_edits(t.vectors[v], symbol, place)
        edits.append(row)
        places.append(place)
    return tuple(edits), tuple(places)


def trace(symbols: np.ndarray, vector: int = 0, place: int = 0, block: int = BLOCK) -> tuple[int, list[str], list[int]]:
    """Cost to the end less that of ``vector``, edits of each row, and the places around the rows."""
    t, numbers = tables(block), blocks_of(symbols, block).tolist()
    behind, cost = [], 0
    for number in reversed(numbers):
        behind.append(vector)
        cost += int(t.cost[vector, number])
        vector = int(t.vector[vector, number])
    cost += t.vectors[vector][place]
    edits: list[str] = []
    places = [place]
    for number, v in zip(numbers, reversed(behind)):
        rows, after = _expand(v, number, places[-1], block)
        edits += rows
        places += after
    return cost, edits[: len(symbols)], places[: len(symbols) + 1]


def effect(symbols: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment, for every vector behind it: the vector before, the cost, the places behind."""
    t = tables(block)
    vector = np.arange(len(t.vectors))
    cost, place = np.zeros(len(vector), dtype=np.int64), np.tile(np.arange(4), (len(vector), 1))
    for number in blocks_of(symbols, block)[::-1]:
        place = np.take_along_axis(place, t.place[vector, number], axis=1)
        cost += t.cost[vector, number]
        vector = t.vector[vector, number]
    return vector, cost, place


# ---- rows ----------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults (conv_id, turn, role, text, copies, gone), drawn by id and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    return rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), case.alias("case")).select(
        "conv_id", "turn",
        F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("case") == 3, 2).otherwise(1).alias("copies"),
        (F.col("case") == 0).alias("gone"),
    )


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, fault and symbol; a gone row only names its conversation."""
    optional = {"copies": F.lit(1), "gone": F.lit(False)}
    extra = [(F.col(c) if c in rows.columns else value).alias(c) for c, value in optional.items()]
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), *extra)
    for c in ("role", "text", "turn"):  # what is gone has neither
        rows = rows.withColumn(c, F.when(~F.col("gone"), F.col(c)))
    tie = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    same = F.md5(F.concat_ws("|", F.col("conv_id").isNull().cast("string"), F.col("conv_id").cast("string"), F.col("tie")))
    counted = (
        rows.withColumn("tie", tie).groupBy("conv_id", "turn", "tie", "role", "text", "gone")
        .agg(F.sum("copies").alias("copies")).withColumn("same", same)
    )
    counted = written(counted, "turns")
    groups = counted.filter(~F.col("gone")).groupBy("same").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1"), "said-again")
    joined = lookup_join(counted, groups.select("same", "earliest"), "same", groups, F.col("turn"))
    again = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(_BLANKS)), -1, 1)
    fault = F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return joined.select("conv_id", "turn", "tie", "role", "text", "gone", "copies", fault.alias("fault"), kind.alias("kind"))


class _Held:
    """A conversation, or the part of one, that a task has read so far."""

    def __init__(self, conv_id, chunk_bytes: int):
        self.conv_id, self.chunk_bytes = conv_id, chunk_bytes
        self.symbols = bytearray()
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.copies: list[int] = []
        self.size = self.chunks = self.start = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = self.extra = self.turns = 0
        self.kinds: tuple[int, int] | None = None  # of the first and the last row
        self.span: tuple[int, int] | None = None  # first and last turn

    def add(self, turn, role, text, copies, fault, kind) -> None:
        self.symbols.append(_MUST_GO if fault in (1, 2) else kind + 4 * (fault == 3))
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.size += len(role) + len(text) + 64
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += copies - 1
        self.extra += copies - 1
        self.illegal += copies - 1
        if self.kinds is not None:
            self.illegal += not _legal(self.kinds[1], kind)
        self.kinds = (kind if self.kinds is None else self.kinds[0], kind)
        if turn is not None:
            if self.span is None or self.span[1] != turn:
                self.turns += 1
            self.span = (turn if self.span is None else self.span[0], turn)

    def take(self) -> tuple[list[str], list[str], list[int]]:
        rows = self.roles, self.texts, self.copies
        self.roles, self.texts, self.copies, self.size = [], [], [], 0
        self.start, self.chunks = len(self.symbols), self.chunks + 1
        return rows


def _legal(left: int, right: int) -> bool:
    return (left, right) in ((0, 1), (1, 2), (2, 1))


def _gaps(span: tuple[int, int] | None, turns: int) -> int:
    return 0 if span is None else span[1] - span[0] + 1 - turns


def repaired(roles, texts, copies, edits: list[str], place: int) -> tuple[str, list[str]]:
    """(edits with those of copies, repaired rows), beginning at ``place``."""
    audit, rows = [], []
    for role, text, n, row in zip(roles, texts, copies, edits):
        for edit in row:
            if edit == "I":
                rows.append(_DUE[place] + ":")
                place = _NEXT[place]
            elif edit == "K":
                rows.append(f"{role}:{text}")
                place = _KEPT[role[0]][place]
            elif edit == "R":
                rows.append(f"{_DUE[place]}:{text}")
                place = _NEXT[place]
        audit.append(row + "D" * (n - 1))
    return "".join(audit), rows


def _inserted(edits: str, place: int) -> list[str]:
    rows = []
    for _ in edits:
        rows.append(_DUE[place] + ":")
        place = _NEXT[place]
    return rows


# ---- tasks -----------------------------------------------------------------------

_SEGMENT = "seg long, rows array<int>, symbols binary, before array<int>, costs array<long>, places array<int>, kinds array<int>, span array<long>, turns long"
_CHUNK = "chunk int, roles array<string>, texts array<string>, copies array<long>"


def _schema(kind: str) -> str:
    return f"conv_id {kind}, {RESULT}, {_SEGMENT}, {_CHUNK}"


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Repair what lies inside the task; of the rest, segments and chunks of rows."""
    held: _Held | None = None
    inside = False  # the first conversation of a task may have begun before it
    done: list[dict] = []
    part, ordinal, rows_of = 0, 0, []

    def chunk(h: _Held) -> dict:
        number, start = h.chunks, h.start
        roles, texts, copies = h.take()
        rows_of.append(len(h.symbols) - start)
        return {"conv_id": h.conv_id, "seg": part << 32 | ordinal, "chunk": number, "roles": roles, "texts": texts, "copies": copies}

    def close(h: _Held, whole: bool) -> None:
        nonlocal ordinal
        sums = {"blank": h.faults[1], "duplicate": h.faults[2], "truncated": h.faults[3], "illegal": h.illegal}
        symbols = np.frombuffer(bytes(h.symbols), dtype=np.uint8)
        if whole and not h.chunks:
            cost, edits, places = trace(symbols)
            audit, rows = repaired(h.roles, h.texts, h.copies, edits, 0)
            tail = last_edits(places[-1])
            text = "\n".join(rows + _inserted(tail, places[-1]))
            done.append(sums | {
                "conv_id": h.conv_id, "gaps": _gaps(h.span, h.turns), "cost": cost + DELETE * h.extra, "audit": audit + tail,
                "repaired_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
            })
            return
        done.append(chunk(h))
        vector, costs, places = effect(symbols)
        done.append(sums | {
            "conv_id": h.conv_id, "seg": part << 32 | ordinal, "rows": list(rows_of), "symbols": bytes(h.symbols),
            "before": vector.tolist(), "costs": (costs + DELETE * h.extra).tolist(), "places": places.ravel().tolist(),
            "kinds": h.kinds, "span": h.span, "turns": h.turns,
        })
        rows_of.clear()
        ordinal += 1

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv_id, turn, role, text, gone, copies, fault, kind, part in zip(*columns):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    close(held, inside)
                    inside = True
                held = _Held(conv_id, chunk_bytes)
            if not gone:
                held.add(turn, role, text, copies, fault, kind)
                if held.size > chunk_bytes:
                    done.append(chunk(held))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if held is not None:
        close(held, False)
        yield pa.RecordBatch.from_pylist(done, schema=schema)


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOLDED = "seg long, vector int, place int, last boolean, " + ", ".join(f"{c} long" for c in _TOTALS)


def _fold(segments: pa.Table) -> pa.Table:
    """Vector behind and place before each segment of a conversation, and its totals."""
    rows = segments.sort_by("seg").to_pylist()
    vector, cost = 0, 0
    for r in reversed(rows):
        r["vector"] = vector
        cost += r["costs"][vector]
        vector = r["before"][vector]
    place = 0
    cost += tables().vectors[vector][place]
    totals = dict.fromkeys(_TOTALS, 0) | {"cost": cost}
    kind = first = last = None
    turns = 0
    for r in rows:
        r["place"] = place
        place = r["places"][4 * r["vector"] + place]
        for c in ("blank", "duplicate", "truncated", "illegal"):
            totals[c] += r[c]
        if r["kinds"] is not None:
            if kind is not None:
                totals["illegal"] += not _legal(kind, r["kinds"][0])
            kind = r["kinds"][1]
        if r["span"] is not None:
            turns += r["turns"] - (last == r["span"][0])
            first, last = (r["span"][0] if first is None else first), r["span"][1]
    totals["gaps"] = 0 if first is None else _gaps((first, last), turns)
    names = ["seg", "vector", "place"]
    out = [{n: r[n] for n in names} | totals | {"last": r is rows[-1]} for r in rows]
    longs = [(c, pa.int64()) for c in _TOTALS]
    return pa.Table.from_pylist(out, pa.schema([("seg", pa.int64()), ("vector", pa.int32()), ("place", pa.int32()), ("last", pa.bool_()), *longs]))


def _trace_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of every chunk of the segments."""
    schema = pa.schema([
        ("seg", pa.int64()), ("chunk", pa.int32()), ("place", pa.int32()), ("edits", pa.list_(pa.string())), ("tail", pa.string()), ("end", pa.int32()),
    ])
    for batch in batches:
        for seg, rows, symbols, vector, place, last in zip(*(c.to_pylist() for c in batch.columns)):
            _, edits, places = trace(np.frombuffer(symbols, dtype=np.uint8), vector, place)
            at = 0
            for number, n in enumerate(rows):
                tail = last_edits(places[-1]) if last and number == len(rows) - 1 else ""
                yield pa.RecordBatch.from_pylist([{
                    "seg": seg, "chunk": number, "place": places[at], "edits": edits[at : at + n], "tail": tail, "end": places[at + n],
                }], schema)
                at += n


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired text of every chunk."""
    for batch in batches:
        out = []
        for place, edits, tail, end, roles, texts, copies in zip(*(c.to_pylist() for c in batch.columns[3:])):
            audit, rows = repaired(roles, texts, copies, edits, place)
            rows += _inserted(tail, end)
            out.append((audit + tail, len(rows), "\n".join(rows).encode("utf-8", "replace")))
        columns = zip(*out) if out else ([], [], [])
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))]
        yield pa.record_batch([*batch.columns[:3], *arrays], names=["conv_id", "seg", "chunk", "audit", "n", "repaired"])


def _join_chunks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its chunks in order; only the edits are held."""
    now, open_, audit, digest, begun = None, False, [], hashlib.sha256(), False

    def finish():
        return pa.record_batch(
            [pa.array([now], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"]
        )

    for batch in batches:
        for conv_id, _, _, edits, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or conv_id != now:
                if open_:
                    yield finish()
                now, open_, audit, digest, begun = conv_id, True, [], hashlib.sha256(), False
            audit.append(edits)
            if n:
                digest.update(b"\n" + text if begun else text)
                begun = True
    if open_:
        yield finish()


# ---- the operator --------------------------------------------------------------------


def repair(rows: DataFrame, part_bytes: int = PART_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation: faults, cost, edits and the hash of the repaired rows.

    ``rows`` has conv_id, turn, role and text, and may have ``copies`` (how often a row
    occurs) and ``gone`` (the row only names its conversation).
    """
    coded = written(_coded(rows), "coded-turns")
    size = coded.agg(F.sum(F.octet_length("role") + F.octet_length("text") + 64)).first()[0] or 0
    kind = coded.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "tie"]
    parts = coded.repartitionByRange(max(1, -(-size // part_bytes)), *order).withColumn("part", F.spark_partition_id())
    parts = parts.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "copies", "fault", "kind", "part")
    schema = _schema(kind)
    spark = rows.sparkSession
    arrow = spark.createDataFrame([], schema).toArrow().schema
    read = written(parts.mapInArrow(lambda b: _read(b, arrow, chunk_bytes), schema), "repair")

    result = [c.split()[0] for c in RESULT.split(", ")]
    whole = read.filter("seg IS NULL").select("conv_id", *result)
    segments = read.filter("symbols IS NOT NULL")
    summary = segments.select(
        "conv_id", "seg", "before", "costs", "places", "kinds", "span", "turns", "blank", "duplicate", "truncated", "illegal",
    )
    folded = written(summary.groupBy("conv_id").applyInArrow(_fold, _FOLDED), "repair-segments")
    traced = segments.select("seg", "rows", "symbols").join(folded.select("seg", "vector", "place", "last"), "seg").mapInArrow(
        _trace_segments, "seg long, chunk int, place int, edits array<string>, tail string, end int",
    )
    chunks = read.filter("chunk IS NOT NULL").select("conv_id", "seg", "chunk", "roles", "texts", "copies")
    edited = chunks.join(traced, ["seg", "chunk"]).select(
        "conv_id", "seg", "chunk", "place", "edits", "tail", "end", "roles", "texts", "copies",
    ).mapInArrow(_apply, f"conv_id {kind}, seg long, chunk int, audit string, n long, repaired binary")
    streamed = edited.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "chunk")
    arrow_id = arrow.field("conv_id").type
    joined = streamed.mapInArrow(lambda b: _join_chunks(b, arrow_id), f"conv_id {kind}, audit string, repaired_sha256 string")
    totals = segments.select(F.col("conv_id").alias("_conv"), "seg").join(folded.filter("last"), "seg").select("_conv", *_TOTALS)
    cut = joined.join(totals, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", *result)
    return whole.unionByName(cut)
