"""SimHash links and components against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textmatch.llm import simhash

from .cases import DOC_SCHEMA, documents, document_rows, words


def plain_fingerprint(text, n=4):
    ws = words(text)
    shingles = [b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(fps, bits=4):
    """Smallest index reachable from each."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_documents_with_awkward_rows(spark):
    rows = document_rows()
    found = simhash.near_duplicates(documents(spark)).collect()
    assert len(found) == len(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(fps)
    smallest = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            smallest[root] = min(smallest.get(root, r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", smallest.get(root)) for r, f, root in zip(rows, fps, roots))
    got = sorted((str(r["doc_id"]), f"{r['fps'][0] & (2**64 - 1):016x}", r["component_id"]) for r in found)
    assert got == want


def test_shingles_of_spark_hash(spark):
    texts = ["a b c d e f a b c d", "One two THREE four five"]
    for t in texts:
        want = spark.createDataFrame([(s,) for s in [" ".join(w.decode() for w in words(t)[i : i + 4]) for i in range(len(words(t)) - 3)]], "s string")
        want = sorted(r[0] & (2**64 - 1) for r in want.select(F.xxhash64("s")).collect())
        assert sorted(simhash.features(t, 4, False).tolist()) == want


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4, 5, 6])
def test_links_connect_as_all_pairs(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = []
    for c in centres:  # groups of near fingerprints, one of them crowded
        for _ in range(80 if c == centres[0] else 6):
            flip = 0
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                flip |= 1 << int(b)
            fps.append(int(c) ^ flip)
    fps = sorted(set(fps))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    # Small blocks send crowded keys through pairs of blocks.
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), max_bits, block=16).collect()
    place = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = e["a"] & (2**64 - 1), e["b"] & (2**64 - 1)
        assert (a ^ b).bit_count() <= max_bits
        i, j = find(place[a]), find(place[b])
        root[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fps))] == plain_components(fps, max_bits)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=9), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_filter_and_keys(fp, flips, max_bits):
    other = fp
    for b in flips:
        other ^= 1 << b
    near = len(flips) <= max_bits
    assert bool(simhash.linked(np.array([fp ^ other], dtype=np.uint64), max_bits)[0]) == near
    if near:
        byte = lambda x, p: x >> (8 * p) & 255
        assert any(byte(fp, p) == byte(other, p) and byte(fp, q) == byte(other, q) for p, q in simhash.key_positions(max_bits))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("500", f"{i}") for i in range(501, 560)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03}"] for i in range(1, 61)} == {"000"} and {got[str(i)] for i in range(501, 560)} == {"500"}


def test_keep_first(spark):
    docs = documents(spark)
    kept = simhash.keep_first(docs, n=1, distinct=True, seeds=6)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 1, 2, 3 and the null rows without words are one group, 6 7 8 9 another, 4 and 11 a third.
    assert ids.count("6") == 1 and not {"7", "8", "9", "2", "3", "11"} & set(ids) and {"1", "4", "5", "10", "12"} <= set(ids)
    assert ids.count("None") == 1  # "no id at all"; the null text goes with 1
    assert {str(100 + i) for i in range(40)} <= set(ids)


def test_empty(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0
