"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors are one node with the smallest ids that carry it, so copies neither fill a
graph nor hide each other. Nodes are dealt to shards of about ``SHARD`` by a hash, and a
task builds the graph of a shard: it starts from random edges; for a batch of nodes a
greedy beam search proposes neighbours, and relaxed pruning keeps a candidate only if no
neighbour kept before is closer to it by the factor ``ALPHA``; reverse edges are added and
pruned alike. Graphs are stored as one row per shard.

Queries go out in blocks to the shards. Each pair of a shard and a block of queries is one group of
work: a beam search in the shard's graph, then the exact distance, in double precision on
the original vectors, for everything in the beam. Graphs and beams use single precision
where all squares fit it, else double. Seen from a far larger vector all small ones tie and would fill its
beam, so a shard has a graph for each band of sizes, and all are searched. The best ``k`` per query over all
shards follow from a window that keeps ``k`` rows of each task before the shuffle.

All rows are indexed; nothing is fitted on a sample. Recall is measured in the tests.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows without an id; vectors meet only those of their own length; rows
that agree in id and vector count once; vectors of any finite size take part; where an
id has several vectors, the smallest is the query and the id's other vectors are no
candidates for it. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written

SHARD = 4096
DEGREE = 36
MIN_IN = 8  # edges that lead to a node, at least
EXTRA = 16  # slots of a node for such edges
BEAM = 96  # while building
SEARCH_BEAM = 128
ALPHA = 1.2
BATCH = 512
QUERY_BLOCK = 1024  # queries that share one copy of a shard's graph
SEED = 42
_WIDTH = 4  # nodes expanded per step
_SAFE = 1e12  # components within this factor of 1 have squares in the range of single precision
_STEP = 256  # queries searched at a time
SPREAD = 4  # partitions for each shard, so that few of them get several
BAND = 40  # vectors whose largest components differ by more than so many powers of two may get graphs of their own


# ---- one graph -------------------------------------------------------------------


def scale(*parts: np.ndarray) -> tuple[type, float]:
    """(precision, factor) in which squared distances of all these vectors are in range.

    Single precision where the largest component of every vector is near 1; else double,
    multiplied by a power of two that keeps sums of squares of the largest finite.
    """
    tops = np.concatenate([np.abs(p).max(1, initial=0.0) for p in parts])
    if not len(tops) or (tops.max() <= _SAFE and tops.min() >= 1 / _SAFE):
        return np.float32, 1.0
    return np.float64, 2.0 ** -max(0, int(np.frexp(tops.max())[1]) - 400)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the vectors ``x`` to ``q``, also where squares leave double precision."""
    with np.errstate(over="ignore", under="ignore"):
        diff = x - q
        square = (diff**2).sum(1)
        plain = np.sqrt(square)
        odd = (square > 1e300) | (square < 1e-280)
        if odd.any():  # take the largest component out before squaring
            diff = diff[odd]
            top = np.abs(diff).max(1)
            unit = diff / np.where(top > 0, top, 1.0)[:, None]
            plain[odd] = top * np.sqrt((unit**2).sum(1))
    return plain


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of nodes; infinite for -1."""
    diff = x[np.maximum(ids, 0)] - q[:, None, :]
    d = np.einsum("qmd,qmd->qm", diff, diff)
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of each query's beam, nearest first; -1 where it is short."""
    n = len(q)
    if len(x) <= beam:
        ids = np.tile(np.arange(len(x)), (n, 1))
        d = _distances(x, ids, q)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    ids = np.full((n, beam), -1)
    ids[:, 0] = entry
    d = _distances(x, ids, q)
    done = np.zeros((n, beam), dtype=bool)
    active = np.arange(n)
    while len(active):
        a_ids, a_d, a_done = ids[active], d[active], done[active]
        open_ = (a_ids >= 0) & ~a_done
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :_WIDTH]
        chosen = np.take_along_axis(open_, pick, 1)
        rows = np.arange(len(active))[:, None]
        a_done[rows, pick] |= chosen
        nodes = np.where(chosen, np.take_along_axis(a_ids, pick, 1), -1)
        found = np.where(nodes[:, :, None] >= 0, edges[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[(found[:, :, None] == a_ids[:, None, :]).any(2)] = -1
        all_ids = np.concatenate([a_ids, found], axis=1)
        all_d = np.concatenate([a_d, _distances(x, found, q[active])], axis=1)
        all_done = np.concatenate([a_done, np.zeros_like(found, dtype=bool)], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        d[active] = np.take_along_axis(all_d, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
        more = ((ids[active] >= 0) & np.isfinite(d[active]) & ~done[active]).any(1)
        active = active[more]
    ids[~np.isfinite(d)] = -1
    return ids, d


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node out of its list of candidates (-1: none)."""
    n, m = candidates.shape
    candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    own = _distances(x, candidates, x[nodes])
    order = np.argsort(own, axis=1, kind="stable")
    candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
    # Seen from the node itself: in a tight cluster, differences of squares far from it cancel.
    points = x[np.maximum(candidates, 0)] - x[nodes][:, None, :]
    square = np.einsum("nmd,nmd->nm", points, points)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    alive = np.isfinite(own)
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for slot in range(degree):
        best = alive.argmax(1)
        has = alive[rows, best]
        if not has.any():
            break
        out[:, slot] = np.where(has, candidates[rows, best], -1)
        alive &= ~((alpha * alpha * between[rows, best] <= own) & has[:, None])
        alive[rows, best] = False
    return out


def _add_reverse(x: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Add the reverse of the nodes' edges; lists that overflow are pruned."""
    source = np.repeat(nodes, edges.shape[1])
    target = edges[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    by_count = np.argsort(count, kind="stable")
    at = 0
    while at < len(touched):
        width = 16
        take = by_count[at : at + BATCH]
        width = int(count[take].max()) if count[take[0]] > 64 or count[take].max() <= 64 else 64
        if width > 64:  # crowded nodes one by one: their lists are long
            take, width = take[:1], int(count[take[0]])
        take = take[count[take] <= width]
        slots = np.arange(width)
        index = np.minimum(first[take][:, None] + slots, len(source) - 1)
        new = np.where(slots < count[take][:, None], source[index], -1)
        lists = np.concatenate([edges[touched[take]], new], axis=1)
        edges[touched[take]] = robust_prune(x, touched[take], lists, degree, alpha)
        at += len(take)


def build(
    x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = SEED,
    min_in: int = MIN_IN, extra: int = EXTRA,
) -> tuple[np.ndarray, int]:
    """(neighbours of each node, entry node) for vectors in the precision of ``scale``."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if n <= beam:
        return np.full((n, degree), -1, dtype=np.int32), entry
    edges = rng.integers(0, n, size=(n, degree))
    edges[edges == np.arange(n)[:, None]] = entry
    for turn in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found, _ = beam_search(x, edges, entry, x[nodes], beam)
            lists = np.concatenate([found, edges[nodes]], axis=1)
            edges[nodes] = robust_prune(x, nodes, lists, degree, turn)
            _add_reverse(x, edges, nodes, degree, turn)
    return reachable(edges, min_in, extra).astype(np.int32), entry


def reachable(edges: np.ndarray, min_in: int, extra: int) -> np.ndarray:
    """Edges with ``extra`` further slots, so that nodes that few point at are found, too.

    In a dense crowd of near copies pruned lists name the same central nodes, and those at
    the rim are in no list. A node with fewer than ``min_in`` edges to it gets them from the
    nearest of its own neighbours with a slot to spare.
    """
    n = len(edges)
    more = np.full((n, extra), -1, dtype=edges.dtype)
    used = np.zeros(n, dtype=np.int64)
    into = np.bincount(edges[edges >= 0], minlength=n)
    for node in np.flatnonzero(into < min_in):
        need = min_in - into[node]
        for near in edges[node]:
            if need <= 0:
                break
            if near >= 0 and used[near] < extra and node not in edges[near]:
                more[near, used[near]] = node
                used[near] += 1
                need -= 1
    return np.concatenate([edges, more], axis=1)


# ---- tables ----------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids: embedding, ids."""
    rows = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    first = W.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= keep)
    return ranked.groupBy("embedding").agg(F.array_sort(F.collect_list(F.col("vec_id").cast("long"))).alias("ids"))


_GRAPH = "dim int, shard int, n int, entry int, vectors binary, edges binary, ids binary, cuts binary"


def build_index(rows: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(one row per graph, number of shards) of ``rows`` (vec_id, embedding)."""
    points = written(nodes(rows, k + 1), "vector-nodes")
    shards = max(1, -(-points.count() // shard))
    top = F.array_max(F.transform("embedding", lambda c: F.abs(c.cast("double"))))
    dealt = points.select(
        F.size("embedding").alias("dim"), F.floor((F.log2(top) + BAND / 2) / BAND).cast("int").alias("band"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"),
        F.transform("embedding", lambda c: c.cast("double")).alias("embedding"), "ids",
    )

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(first=group["ids"].str[0]).sort_values("first", kind="stable")
        vectors = np.stack(group["embedding"].to_numpy())
        kind, factor = scale(vectors)
        edges, entry = build((vectors * factor).astype(kind))
        ids = np.concatenate(group["ids"].to_numpy()).astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum(group["ids"].str.len()))).astype(np.int64)
        row = (key[0], key[2], len(vectors), entry, vectors.tobytes(), edges.tobytes(), ids.tobytes(), cuts.tobytes())
        return pd.DataFrame([row], columns=["dim", "shard", "n", "entry", "vectors", "edges", "ids", "cuts"])

    # A task builds few graphs: they are few bytes and much work, so sizes would put many into one.
    dealt = dealt.repartition(SPREAD * shards, "dim", "shard")
    return written(dealt.groupBy("dim", "band", "shard").applyInPandas(run, _GRAPH), "graphs"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found for ``queries`` (vec_id, embedding): query_id, rank, vec_id, score."""
    queries = queries.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    queries = written(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = queries.select(
        F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
        F.struct(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("v")).alias("q"),
    ).groupBy("dim", "block").agg(F.collect_list("q").alias("queries"))
    # Every shard gets all queries: copies that Spark does not foresee, and would collect to broadcast them.
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).hint("merge")
    work = asked.join(graphs.repartition(SPREAD * shards, "dim", "shard"), ["dim", "shard"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in group.itertuples():
            x = np.frombuffer(g.vectors).reshape(g.n, g.dim)
            edges = np.frombuffer(g.edges, dtype=np.int32).reshape(g.n, -1)
            ids, cuts = np.frombuffer(g.ids, dtype=np.int64), np.frombuffer(g.cuts, dtype=np.int64)
            names = [q["id"] for q in g.queries]
            q = np.array([q["v"] for q in g.queries])
            kind, factor = scale(x, q)
            scaled, asked = (x * factor).astype(kind), (q * factor).astype(kind)
            parts = [beam_search(scaled, edges, g.entry, asked[a : a + _STEP], max(beam, 2 * k))[0] for a in range(0, len(q), _STEP)]
            found = np.concatenate(parts)
            for i, name in enumerate(names):
                near = found[i][found[i] >= 0]
                score = distances(x[near], q[i])
                best = sorted(
                    (s, int(v)) for s, p in zip(score.tolist(), near) for v in ids[cuts[p] : cuts[p + 1]] if v != name
                )[:k]
                out += [(name, v, s) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = work.groupBy("dim", "shard", "block").applyInPandas(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index all ``rows`` and search it for ``queries``; both have vec_id and embedding."""
    graphs, shards = build_index(rows, k)
    return search(graphs, shards, queries, k)
