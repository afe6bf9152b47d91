"""Ranked search against a plain loop over all items and documents."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from textmatch.llm import lexical

from .cases import DOC_SCHEMA, documents, document_rows, say, with_clashes

ITEM_SCHEMA = "item_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(rows, items, k=10):
    docs = [(r[0], terms(r[1])) for r in rows]
    docs = [d for d in docs if d[1]]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = []
    for i, own in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in docs) + 1))) for t in own}
        scored = []
        for doc_id, d in docs:
            m = 10 + 90 * len(d) * n_docs // n_terms
            score = sum(w * (10**9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t, w in weight.items() if t in d)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def items(seed=3):
    draw = random.Random(seed)
    known = [r[1] for r in document_rows() if r[1] and len(r[1]) < 3000]
    rows = [(1, known[-1]), (2, "one"), (3, None), (4, "-- !"), (None, "Ünïcode 漢字"), (None, "words"), (5, known[3]), (5, "one one"), (6, "nothing-like-it")]
    return rows + [(10 + i, say(draw, 30, 3000)) for i in range(12)]


def got(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def test_search_equals_all_pairs(spark):
    rows = document_rows() + [(500 + i, "one two", "en", "a", 1) for i in range(40)]  # ties beyond k
    table = with_clashes(spark.createDataFrame(items(), ITEM_SCHEMA))
    found = lexical.search(documents(spark, rows).repartition(5), table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == plain(rows, items())


def test_groups_of_items_change_nothing(spark):
    table = spark.createDataFrame(items(), ITEM_SCHEMA)
    sizes = [len(g.columns) for g in lexical.groups(lexical.item_terms(table), 60)]
    assert len(sizes) > 3
    assert got(lexical.search(documents(spark), table, group_terms=60)) == plain(document_rows(), items())


def test_narrow_tiles_stay_exact(spark):
    """Two columns a tile, a bound that their sums just keep, and few documents a tile."""
    rows = document_rows()
    table = spark.createDataFrame(items(), ITEM_SCHEMA)
    group = next(lexical.groups(lexical.item_terms(table)))
    posted = lexical.postings(documents(spark, rows), group.vocabulary)
    n_docs, n_terms = posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = lexical.document_frequencies(posted, len(group.vocabulary))
    top = max(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()) * 10**6
    found = lexical.best_matches(posted, group, n_docs, n_terms, df, 10, exact=2 * top + 1, doc_tile=7, item_tile=3)
    by_item = {}
    for r in found.collect():
        by_item.setdefault(group.ids[r["item"]], []).append((-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    want = {}
    for i, _, doc_id, score in plain(rows, items()):
        want.setdefault(i, []).append((-score, doc_id is None, doc_id or 0))
    assert {i: sorted(b)[:10] for i, b in by_item.items()} == {i: sorted(b) for i, b in want.items()}


def test_best_keeps_ties_of_smaller_ids():
    draw = np.random.default_rng(1)
    best, every = lexical.Best(3, 4), []
    for _ in range(20):
        scores, ids = draw.integers(0, 4, (50, 3)), draw.integers(-1000, 1000, 50)
        missing = draw.random(50) < 0.05
        best.add(0, scores, np.where(missing, 0, ids), missing)
        every += [(i, -int(s), bool(none), 0 if none else int(d)) for row, d, none in zip(scores, ids, missing) for i, s in enumerate(row) if s > 0]
    want = [row for i in range(3) for row in sorted(e for e in every if e[0] == i)[:4]]
    item, score, none, doc = (c.tolist() for c in best.rows)
    assert sorted(zip(item, [-s for s in score], none, doc)) == sorted(want)


def test_empty_tables(spark):
    table, none = spark.createDataFrame(items(), ITEM_SCHEMA), spark.createDataFrame([], ITEM_SCHEMA)
    assert lexical.search(documents(spark), none).count() == 0
    assert lexical.search(spark.createDataFrame([], DOC_SCHEMA), table).count() == 0
    assert lexical.search(documents(spark, [(1, None, None, None, None), (2, " . ", None, None, None)]), table).count() == 0
