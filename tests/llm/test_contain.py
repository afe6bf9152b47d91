"""Containment search against all pairs."""

import random

from textmatch.llm import contain

from .cases import DOC_SCHEMA, documents, document_rows, say, words, with_clashes


def plain_shingles(text, n=5):
    ws = words(text)
    return {b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def items(seed=1):
    draw = random.Random(seed)
    return [
        (1, say(draw, 12)), (2, say(draw, 45)), (3, "one"), (4, None), (5, ""), (6, say(draw, 5)), (7, say(draw, 200)),
        (None, say(draw, 20)), (1, say(draw, 9)), (8, say(draw, 45)), (8, say(draw, 45)),
    ]


def leaks(seed=2):
    draw = random.Random(seed)
    rows = document_rows()
    for k, (_, text) in enumerate(items()):
        ws = (text or "").split()
        for cut in (0, len(ws) // 10, len(ws) // 6, len(ws) // 3):
            part = ws[: len(ws) - cut]
            rows.append((1000 + 10 * k + cut, f"{say(draw, 300)} {' '.join(part).upper()} {say(draw, draw.randint(0, 3000))}", "en", "a", 1))
    rows.append((None, items()[1][1], "en", "a", 1))
    rows.append((2000, items()[1][1], "en", "a", 1))
    rows.append((2000, "another text of this id", "en", "a", 1))
    return rows


def test_against_all_pairs(spark):
    found = contain.contaminated(documents(spark, leaks()), with_clashes(spark.createDataFrame(items(), "item_id long, text string")))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in found.collect()}
    want = {}
    for doc_id, text, *_ in leaks():
        mine = plain_shingles(text)
        for item_id, item in items():
            parts = plain_shingles(item)
            if parts and len(parts & mine) >= 0.8 * len(parts):
                key, value = (doc_id, item_id), (len(parts), len(parts & mine))
                if key not in want or value[1] / value[0] > want[key][1] / want[key][0]:
                    want[key] = value
    assert got == want and len(got) > 20 and (None, 2) in got and (2000, 2) in got


def test_both_joins_agree(spark, monkeypatch):
    docs, bench = documents(spark, leaks()), spark.createDataFrame(items(), "item_id long, text string")
    one = sorted(map(str, contain.contaminated(docs, bench).collect()))
    monkeypatch.setattr(contain, "BROADCAST_BYTES", 0)
    assert sorted(map(str, contain.contaminated(docs, bench).collect())) == one


def test_clean_keeps_all_others(spark):
    docs = documents(spark, leaks())
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = contain.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {(r["doc_id"]) for r in contain.contaminated(docs, bench).collect()}
    rows = [r for r in leaks() if r[0] not in bad or r[0] in (None, 2000) and r[1] != items()[1][1]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows)


def test_empty(spark):
    docs, bench = documents(spark), spark.createDataFrame(items(), "item_id long, text string")
    none, no_items = spark.createDataFrame([], DOC_SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert contain.contaminated(none, bench).count() == 0 and contain.contaminated(docs, no_items).count() == 0
    assert contain.clean(docs, no_items).count() == docs.count()


def test_no_python_in_the_plan(spark):
    found = contain.contaminated(documents(spark), spark.createDataFrame(items(), "item_id long, text string"))
    assert "Python" not in found._jdf.queryExecution().toString()
