"""Mixing against a step-by-step apportionment."""

import random

from pyspark.sql import functions as F

from textmatch.llm import mixing

from .cases import DOC_SCHEMA, documents, document_rows, words


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return names, share | full
        full |= {s: float(cap * sizes[s]) for s in over}


def test_targets_quotas_and_documents(spark):
    rows = document_rows()
    documents_, runs = mixing.mix(documents(spark), block=16, shards=4)
    got = documents_.collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    names, target = plain_targets(sizes)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    total = sum(sizes.values())
    # One block after the other to the highest quotient.
    seats = -(-total // 16)
    has = dict.fromkeys(names, 0)
    steps = []
    for _ in range(seats):
        best = max((s for s in names if target[s] > 0), key=lambda s: target[s] / (2 * has[s] + 1))
        has[best] += 1
        steps.append(dict(has))
    assert taken == {s: min(16 * has[s], 3 * sizes[s]) for s in names}
    for r in runs.collect():
        after = steps[seats * (r["shard"] + 1) // 4 - 1][r["source"]]
        assert r["high"] == min(16 * after, 3 * r["source_size"])
    # The parts of documents in the shards add up to what is taken.
    parts = mixing.slices(documents_, runs).groupBy("source").agg(F.sum("n_words").alias("n")).collect()
    assert {r["source"]: r["n"] for r in parts} == {s: n for s, n in taken.items() if n}


def test_reruns_agree_and_each_source_is_near_its_target(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)), "en", f"s{draw.randrange(7)}" if i % 3 else "hot", 0) for i in range(900)]
    docs = documents(spark, rows)
    one = sorted(mixing.mix(docs)[0].collect(), key=str)
    two = sorted(mixing.mix(docs.repartition(7))[0].collect(), key=str)
    assert one == two
    by = {}
    for r in one:
        t, n = by.get(r["source"], (r["target"], 0))
        by[r["source"]] = (t, n + r["taken"])
    assert all(abs(t - n) <= 2 * mixing.BLOCK for t, n in by.values())


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOC_SCHEMA))[0].count() == 0
    got = mixing.mix(documents(spark, [(1, None, None, None, None), (2, "", None, "a", 0)]))[0].collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2
