"""Graph search against all distances."""

import numpy as np
import pytest

from textmatch.llm import graph_search as gs

from .cases import with_clashes


def plain(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v) for n, (i, v) in enumerate(good) if not any(i == j and np.array_equal(v, w) for j, w in good[:n])]
    out = {}
    for i in {i for i, _ in good if i % 100 == 0}:
        q = min((v for j, v in good if j == i), key=tuple)
        near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))
        out[i] = near[:k]
    return out


def run(spark, rows, k=10, **settings):
    table = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    graphs, shards = gs.build_index(table, k, **settings)
    found = gs.search(graphs, shards, table.filter("vec_id % 100 = 0"), k).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_awkward_rows_on_small_shards_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(301)]
    same = rng.normal(size=8).round(2).tolist()
    rows += [(400 + i, same) for i in range(120)]  # copies: ties go to the smaller id
    rows += [(900, None), (901, []), (902, [0.0] * 8), (1000, [float("nan")] + [1.0] * 7), (1001, [None] + [1.0] * 7), (1002, [float("inf")] + [1.0] * 7)]
    rows += [(None, [1.0] * 8), (1100, [1.0, 2.0]), (1101, [1.0, 2.5]), (1200, same), (1200, same), (1300, rows[5][1]), (1300, rows[6][1])]
    want = plain(rows, 10)
    for shard in (1000, 60):
        got = run(spark, rows, shard=shard)
        assert set(got) == set(want)
        for q, near in want.items():
            assert [v for _, v in got[q]] == [v for _, v in near]
            assert np.allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=1e-14, atol=0)


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_recall(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    want, got = plain(rows, 10), run(spark, rows, shard=1500)
    hit = sum(len({v for _, v in want[q]} & {v for _, v in got[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("factor", [1e-24, 1e19, None])
def test_any_finite_size(spark, factor):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    if factor is None:  # sizes side by side
        x *= np.where(np.arange(600) % 3 == 0, 1e-24, np.where(np.arange(600) % 3 == 1, 1.0, 1e19))[:, None]
        x[::100] = rng.normal(size=(6, 16)) * np.array([1e-24, 1.0, 1e19] * 2)[:, None]
    else:
        x *= factor
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    want, got = plain(rows, 10), run(spark, rows, shard=300)
    assert {q: len(r) for q, r in got.items()} == {q: 10 for q in want}
    if factor is None:  # among far larger vectors all the small ones tie; the nearest distances agree
        assert all(np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-6, atol=0) for q in (100, 200, 400, 500))
    else:
        hit = sum(len({v for _, v in want[q]} & {v for _, v in got[q]}) for q in want)
        assert hit >= 0.95 * 10 * len(want)


def test_distances_beyond_squares():
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0]])
    assert np.allclose(gs.distances(x, np.zeros(2)), [5e200, 5e-200, 5.0, 0.0], rtol=1e-15, atol=0)
    assert gs.scale(x) == (np.float64, 2.0 ** -(int(np.frexp(4e200)[1]) - 400)) and gs.scale(x[2:3])[0] is np.float32


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-3, 0]], dtype=np.float32)
    got = gs.robust_prune(x, np.array([0]), np.array([[4, 2, 1, 3, 0, 1]]), 4, 1.2)
    assert got.tolist() == [[1, 3, 4, -1]]


def test_few_rows_and_none(spark):
    assert run(spark, [(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])]) == {100: [(0.0, 1), (2.0, 2)]}
    assert run(spark, [(100, [1.0, 2.0])]) == {}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert gs.nearest(empty, empty).count() == 0


def test_queries_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i), 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    graphs, shards = gs.build_index(rows, 3, shard=50)
    found = gs.search(graphs, shards, rows.filter("vec_id % 100 = 0"), 3)
    # One copy of all queries for every shard: collected for a broadcast, they outgrow the driver.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 12
