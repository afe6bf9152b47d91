"""SimHash near-duplicates through an index of fingerprint bytes.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits agree in at least
``8 - max_bits`` byte positions. A posting of a single position holds 1/256 of all
fingerprints, whatever the corpus, so postings of two positions are intersected: the
positions are dealt to one group fewer than the guaranteed matches, hence two of the
matching positions share a group, and every pair of positions of a group is a key.
Inside a key the shared bytes of each pair are tallied, pairs below the guaranteed
minimum are dropped, and the rest is verified by counting the differing bits.

Equal fingerprints count once, so copies cost nothing. A key gives links that connect
its members, not all pairs; a key with many members is cut to blocks, and each pair of
blocks is a task of its own, so no link is lost.

Defined results: a null or empty text has fingerprint zero; all such rows link with each
other. Repeated rows share a component. A null ``doc_id`` never names a component unless
the component has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..session import written
from .words import lower, mix

BITS, BYTES = 64, 8
BLOCK = 32768  # members of a key that one task compares
_SMALL = 12  # up to here a key's pairs are compared by shifted arrays
_SLICE = 1 << 15
_U = np.uint64


# ---- fingerprints --------------------------------------------------------------


def features(text: str | None, n: int, distinct: bool) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = lower(text).split()
    if len(words) <= n:
        shingles = [b" ".join(words)] if words else []
    elif n == 1:
        shingles = words
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    if distinct:
        shingles = sorted(set(shingles))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=len(shingles))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it; zero without hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, n: int = 4, distinct: bool = False, seeds: int = 1) -> Column:
    """Fingerprints of a text as an array; more ``seeds`` remix the same shingle hashes."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            hashes = features(t, n, distinct)
            out.append([
                majority(mix(hashes + _U(s * 0x9E3779B97F4A7C15 % (1 << 64))) if s else hashes) for s in range(seeds)
            ])
        return pd.Series(out)

    return run(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


# ---- links ---------------------------------------------------------------------


def key_positions(max_bits: int) -> list[tuple[int, int]]:
    """Pairs of byte positions, one of which any two linked fingerprints share."""
    matches = BYTES - max_bits
    if not 2 <= matches <= BYTES:
        raise ValueError("max_bits must be 0 to 6")
    groups = max(1, matches - 1)
    members = [[p for p in range(BYTES) if p % groups == g] for g in range(groups)]
    pairs = [pair for m in members for pair in combinations(m, 2)]
    return pairs or [(0, 1)]


def linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which differences of two fingerprints pass the byte tally and the bit count."""
    low = _U(0x7F7F7F7F7F7F7F7F)
    differing = (((x & low) + low) | x) & ~low  # the top bit of each byte that differs
    shared = BYTES - np.bitwise_count(differing)
    return (shared >= BYTES - max_bits) & (np.bitwise_count(x) <= max_bits)


def _connect(members: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the members as all their links do: a search from each start."""
    rest = members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = linked(rest ^ one, max_bits)
            if near.any():
                found, rest = rest[near], rest[~near]
                yield np.full(len(found), one), found
                queue.extend(found)


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of the fingerprints of each key; rows come sorted by key and block pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keyed(batch):
        key = np.asarray(batch.column(0)).astype(np.int64)
        pair = np.asarray(batch.column(1)).astype(np.int64)
        return key, pair, np.asarray(batch.column(2)).astype(np.int64).view(np.uint64)

    def solve(key, pair, fp):
        a, b = [], []
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(key)])))
        group = np.repeat(np.arange(len(starts)), sizes)
        is_small = np.repeat(sizes <= _SMALL, sizes)
        sk, sf = group[is_small], fp[is_small]
        for shift in range(1, _SMALL):
            same = sk[shift:] == sk[:-shift]
            if not same.any():
                break
            left, right = sf[:-shift][same], sf[shift:][same]
            near = linked(left ^ right, max_bits)
            a.append(left[near])
            b.append(right[near])
        for start, size in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL]):
            for x, y in _connect(fp[start : start + size], max_bits):
                a.append(x)
                b.append(y)
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(keyed(batch))
        key, pair, _ = held[-1]
        open_from = int(np.flatnonzero((key != key[-1]) | (pair != pair[-1]))[-1]) + 1 if (
            key[0] != key[-1] or pair[0] != pair[-1]) else 0
        if open_from or len(held) > 1 and (held[0][0][0], held[0][1][0]) != (key[-1], pair[-1]):
            whole = [np.concatenate([h[i] for h in held]) for i in range(3)]
            cut = len(whole[0]) - (len(key) - open_from)
            result = solve(*(w[:cut] for w in whole)) if cut else None
            if result is not None:
                yield result
            held = [tuple(w[cut:] for w in whole)]
    if held:
        result = solve(*(np.concatenate([h[i] for h in held]) for i in range(3)))
        if result is not None:
            yield result


def links(fps: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column ``fp``."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [
        F.shiftleft(F.lit(i), 16) + F.shiftleft(byte(p), 8) + byte(q)
        for i, (p, q) in enumerate(key_positions(max_bits))
    ]
    postings = fps.select("fp").distinct().select(F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"), "fp")
    crowded = (
        postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    dealt = (
        postings.join(crowded, "key", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)).cast("long"))
        .withColumn("other", other)
        .select("key", (F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other")).alias("pair"), "fp")
    )
    run = lambda batches: _links(batches, max_bits)
    sorted_keys = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "fp")
    return sorted_keys.mapInArrow(run, "a long, b long").distinct()


# ---- components ----------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node (root) of each node's component, for all nodes with an edge.

    Alternating star contraction: neighbours larger than a node move to its smallest
    neighbour, then smaller ones do. Every round is written, so a lost executor repeats
    one round at most.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return written(e.groupBy("a").agg(F.min("b").alias("m")), name)

    # The smallest neighbours are written before they are joined back: a node that most
    # others meet is then a crowded key of a plain join, which adaptive execution splits.
    edges = written(edges.filter(F.col("a") != F.col("b")).distinct(), name)
    seen = None
    while True:
        every = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = every.join(smallest(every), "a").filter(F.col("b") > F.col("a"))
        down = written(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), name)
        small = down.join(smallest(down), "a")
        small = small.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*").filter(F.col("a") != F.col("b"))
        edges = written(small.distinct(), name)
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    n: int = 4, distinct: bool = False, seeds: int = 1, max_bits: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest of the text, fps, root, component_id.

    Rows link if any of their ``seeds`` fingerprints differ in at most ``max_bits`` bits.
    ``component_id`` is the smallest id that links reach, the row's own included; ``root``
    names the component even where no row of it has an id.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        fingerprints(F.col(text), n, distinct, seeds).alias("fps"),
    )
    rows = written(rows, "fingerprints").withColumn("node", F.concat_ws("", F.transform("fps", as_hex)))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fps").alias("fps"))
    if seeds > 1:
        nodes = written(nodes, "nodes")
    edges = None
    for s in range(seeds):
        own = nodes.select("node", F.get("fps", F.lit(s)).alias("fp"))
        pairs = links(own.select("fp"), max_bits)
        if seeds == 1:
            found = pairs.select(as_hex(F.col("a")).alias("a"), as_hex(F.col("b")).alias("b"))
        else:
            # A node meets others at a hub, its fingerprint of this seed; hubs that join
            # nothing are left out.
            pairs = written(pairs, "links")
            hub = lambda c: F.concat(F.lit(f"~{s}:"), as_hex(F.col(c)))
            busy = pairs.select(F.explode(F.array("a", "b")).alias("fp")).union(
                own.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
            ).distinct()
            found = own.join(busy, "fp", "left_semi").select(F.col("node").alias("a"), hub("fp").alias("b")).union(
                pairs.select(hub("a").alias("a"), hub("b").alias("b"))
            )
        edges = found if edges is None else edges.union(found)
    roots = components(edges)
    placed = nodes.join(roots, "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root")
    )
    placed = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    return rows.join(placed.select("node", "root", "component_id"), "node").drop("node")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each component, with all columns of ``docs``.

    It is the row with the smallest id (null last), then the smallest text digest; of
    rows that agree in both, the one with the smallest hash of all columns.
    """
    return first_rows(docs, written(near_duplicates(docs, doc_id, text, **settings), "near-duplicates"), doc_id, text)


def first_rows(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that stay, given doc_id, digest and root of every row."""
    identity = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    best = found.groupBy("root").agg(F.min(identity).alias("best"))
    lost = found.join(best, "root").filter(~identity.eqNullSafe(F.col("best")))
    keys = ["_key", "_digest"]
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    lost = lost.select(key("doc_id").alias("_key"), F.col("digest").alias("_digest")).distinct()
    keyed = docs.withColumns({"_key": key(doc_id), "_digest": F.md5(F.coalesce(F.col(text), F.lit("")))})
    keyed = keyed.join(lost, keys, "left_anti")
    order = W.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return keyed.withColumn("_copy", F.row_number().over(order)).filter("_copy = 1").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
