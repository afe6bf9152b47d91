"""Cuts, word orders, picks and masks against plain Python; their draws are made in batches, not in lambdas."""

import random
from dataclasses import replace
from hashlib import md5

import numpy as np
import pytest

from textmatch.functions.draws import digests
from textmatch.operators import pretraining as P, tokens as K
from textmatch.options import DEFAULTS

OPTIONS = replace(DEFAULTS, max_seq_length=40, max_predictions=6)


def u(purpose, key, p):
    return int(md5("|".join(["42", purpose, *[str(k) for k in key if k is not None], str(p)]).encode()).hexdigest()[:8], 16) / 2**32


def words(tokens):
    out = []
    for i, t in enumerate(tokens):
        if t not in ("[CLS]", "[SEP]"):
            out.append([i]) if not out or not t.startswith("##") else out[-1].append(i)
    return out


def shuffled(tokens, key):
    return sorted(words(tokens), key=lambda w: md5("|".join(["42", "mask", *[str(k) for k in key if k is not None], str(w[0])]).encode()).hexdigest())


@pytest.fixture(scope="module")
def pairs(spark):
    draw = random.Random(4)
    side = lambda n: [draw.choice(["ab", "c", "##d", "##e", "ü"]) for _ in range(n)]
    rows = [(i % 3, i if i % 7 else None, i % 5, side(draw.randint(0, 70)), side(draw.randint(0, 70)), i % 2 == 0) for i in range(120)]
    schema = "round int, doc_id bigint, start int, tokens_a array<string>, tokens_b array<string>, is_random_next boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


def key(r):
    return r.round, r.doc_id, r.start


def test_cuts(pairs):
    def cut(tokens, name, keep, k):
        front = sum(u(f"front_{name}", k, i) < 0.5 for i in range(1, len(tokens) - keep + 1))
        return tokens[front : front + keep]

    want = {}
    for r in pairs.collect():
        a, b = len(r.tokens_a), len(r.tokens_b)
        while a + b > 37:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        want[key(r), r.is_random_next] = (cut(r.tokens_a, "a", a, key(r)), cut(r.tokens_b, "b", b, key(r)))
    out = P.truncated(pairs, OPTIONS)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(key(r), r.is_random_next): (r.tokens_a, r.tokens_b) for r in out.collect()} == want


def test_orders_picks_and_masks(spark, pairs, monkeypatch):
    monkeypatch.setattr(K, "PART_ITEMS", 100)
    instances = P.assembled(P.truncated(pairs, OPTIONS)).cache()
    ordered, picked = P.shuffled_words(instances, OPTIONS), P.picked_positions(instances, OPTIONS)
    assert "md5" not in ordered._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in picked._jdf.queryExecution().optimizedPlan().toString()
    for r in ordered.collect():
        assert r.words == shuffled(r.tokens, key(r))
    vocab = spark.createDataFrame([(f"r{i}", 10 + 3 * i) for i in range(50)], "token string, id int")
    places = {}
    for r in picked.collect():
        left, places[key(r), tuple(r.tokens)] = max(1, min(6, round(len(r.tokens) * 0.15))), []
        for w in shuffled(r.tokens, key(r)):
            if len(w) <= left:
                left -= len(w)
                places[key(r), tuple(r.tokens)] += w
        assert r.positions == sorted(places[key(r), tuple(r.tokens)])
    picked = picked.cache()
    masked = P.masked(picked, vocab, OPTIONS)
    assert "md5" not in masked._jdf.queryExecution().optimizedPlan().toString()
    kept = {(key(r), r.is_random_next): r for r in picked.collect()}
    seen = set()
    for r in masked.collect():
        was, k = kept[key(r), r.is_random_next], key(r)
        assert r.masked_lm_positions == was.positions
        assert r.masked_lm_labels == [was.tokens[p] for p in was.positions]
        new = list(was.tokens)
        for p in was.positions:
            how = "mask" if u("mask80", k, p) < 0.8 else "keep" if u("keep50", k, p) < 0.5 else "random"
            seen.add(how)
            new[p] = {"mask": "[MASK]", "keep": new[p], "random": f"r{int(u('token', k, p) * 50)}"}[how]
        assert r.tokens == new
    assert seen == {"mask", "keep", "random"}


def test_nothing_and_null_lists(spark):
    rows = [(0, 1, 0, None), (0, 2, 0, []), (0, 3, 0, ["[CLS]", "[SEP]"])]
    df = spark.createDataFrame(rows, "round int, doc_id bigint, start int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 1)], "token string, id int")
    got = {r.doc_id: r for r in P.masked(P.picked_positions(P.shuffled_words(df)), vocab).collect()}
    assert got[1].tokens is None and got[1].words is None and got[1].masked_lm_positions is None
    for d in (2, 3):
        assert got[d].tokens == rows[d - 1][3] and got[d].words == [] and got[d].masked_lm_positions == got[d].masked_lm_labels == []
    assert P.picked_positions(df.limit(0)).collect() == []


def test_digests_of_short_and_long_keys():
    for extra in ("", "x" * 60):  # one block, and more than one
        keys = [f"|{i}|{10**i}{extra}".encode() for i in range(12)] + ["|ü|9".encode(), b""]
        row, place = np.repeat(np.arange(14), 130), np.tile(np.arange(130), 14)
        got = digests(42, "mask", keys, row, place).tolist()
        want = [md5(b"42|mask" + keys[r] + b"|%d" % p).hexdigest() for r, p in zip(row, place)]
        assert ["%016x%016x" % (a, b) for a, b in got] == want


def test_stored_segments_are_the_numbered_ones(spark):
    rows = [(1, 3, ["a", "##b"]), (1, 1, []), (1, 0, ["", "x y"]), (None, 2, ["c"]), (2, 5, [""]), (2, 5, ["d"] * 9)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, seg_no int, tokens array<string>")
    stored, plain = P.stored_segments(tokens), P.numbered_segments(tokens)
    same = lambda df: sorted(map(str, df.select("doc_id", "seg_no", "tokens").collect()))
    assert len(same(stored)) == 5 and {r.len for r in stored.filter("doc_id = 1").collect()} == {2}
    assert same(stored.filter("doc_id = 1 OR doc_id IS NULL")) == same(plain.filter("doc_id = 1 OR doc_id IS NULL"))
    lengths = P.document_lengths(stored)
    assert "split" not in lengths._jdf.queryExecution().optimizedPlan().toString()  # no token is read for them
    assert {r.doc_id: sorted(r.lens) for r in lengths.collect()} == {1: [2, 2], None: [1], 2: [1, 9]}
    assert sorted(map(str, P.pages(stored, 3).filter("doc_id = 1").collect())) == sorted(map(str, P.pages(plain, 3).filter("doc_id = 1").collect()))
