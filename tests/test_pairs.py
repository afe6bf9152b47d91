"""Sentence pairs, whole words and masks against plain Python, and what their plans move."""

import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from textmatch.operators import pretraining as P
from textmatch.options import DEFAULTS, SPECIAL_TOKENS

OPTIONS = replace(DEFAULTS, max_seq_length=40, dupe_factor=3)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def segments_of(spark):
    rng = random.Random(6)
    words = ["a", "##b", "", "two words", " blank", '"q"', "[x]", "é", "\n"]
    rows = [
        (d, s, [rng.choice(words) for _ in range(rng.choice([1, 1, 2, 9, 60]))])
        for d in range(9) for s in range(500 if d < 2 else rng.randint(1, 20))
    ]
    rows += [(d, 500, [""]) for d in range(9)]
    return spark.createDataFrame(rows, "doc_id bigint, seg_no int, tokens array<string>")


def test_pairs_move_no_token_once_per_round(spark, tmp_path):
    segs = P.numbered_segments(segments_of(spark))
    ranked = P.ranked_documents(P.document_lengths(segs), 42)
    plan = P.plan_chunks(ranked, OPTIONS)
    tables = []
    for name, df in (("segs", segs), ("ranked", ranked), ("plan", plan)):
        df.write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    segs, ranked, plan = tables
    pairs = P.sentence_pairs(plan, segs, ranked, OPTIONS)
    # Ranges of up to 37 segments of another document were moved and grouped by chunk before.
    assert "start#" not in "".join(re.findall(r"Aggregate\(keys=\[([^\]]*)\]", physical(pairs)))
    texts = {}
    for r in segs.orderBy("doc_id", "seg_no").collect():
        texts.setdefault(r.doc_id, []).append(r.tokens)
    drawn = P.other_document(plan.filter("is_random_next"), ranked, OPTIONS.seed)
    other = {(r.round, r.doc_id, r.start): (r.b_doc, r.b_start) for r in drawn.collect()}
    want = {}
    for r in plan.collect():
        key, own = (r.round, r.doc_id, r.start), texts[r.doc_id]
        a, b = sum(own[r.start:r.a_end], []), sum(own[r.a_end:r.end], [])
        if r.is_random_next:
            doc, at = other[key]
            b = list(texts[doc][at])
            while len(b) < r.target - len(a) and at + 1 < len(texts[doc]):
                at += 1
                b += texts[doc][at]
        want[key] = (a, b, r.is_random_next)
    got = {(r.round, r.doc_id, r.start): (r.tokens_a, r.tokens_b, r.is_random_next) for r in pairs.collect()}
    assert got == want


def test_packed_tokens_come_back(spark):
    rows = [["a", "b"], [""], [], ["", "x"], [" "], ["a b", "c"], ["[1]"], [None, "a"], None, ["\\", '"', "\n"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t array<string>")
    back = df.select("i", P.unpacked(P.packed(F.col("t"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in back] == rows


def test_whole_words(spark):
    def plain(tokens):
        groups = []
        for i, t in enumerate(tokens):
            if t in (None, "[CLS]", "[SEP]"):
                continue
            if groups and t.startswith("##"):
                groups[-1].append(i)
            else:
                groups.append([i])
        return groups

    rng = random.Random(3)
    rows = [[rng.choice(["[CLS]", "##b", "c", "[SEP]", "##d", None]) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t array<string>").repartition(2)
    got = {r.i: r.w for r in df.select("i", P.whole_words(F.col("t")).alias("w")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(rows)}


def test_masks_move_no_row_while_the_vocabulary_fits(spark, monkeypatch):
    from textmatch.operators import tokens as K

    vocab = spark.createDataFrame([(t, 3 * i) for i, t in enumerate([*SPECIAL_TOKENS, "x", "y"])], "token string, id int")
    tokens = ["[CLS]", *(f"w{i}" for i in range(20)), "[SEP]"]
    rows = [(0, d, 0, tokens, [] if d == 3 else [2, 5, 6, 9, 11 + d % 5]) for d in range(40)]
    df = spark.createDataFrame(rows, "round int, doc_id bigint, start int, tokens array<string>, positions array<int>")
    results = []
    for limit in (K.MAX_VOCABULARY_BYTES, 0):
        monkeypatch.setattr(K, "MAX_VOCABULARY_BYTES", limit)
        out = P.masked(df, vocab, OPTIONS)
        if limit:
            assert "Join" not in physical(out) and "Exchange hashpartitioning(round" not in physical(out)
        results.append({r.doc_id: (r.tokens, r.masked_lm_positions, r.masked_lm_labels) for r in out.collect()})
    assert results[0] == results[1] and len(results[0]) == 40
    changed = [t for new, at, _ in results[0].values() for t in [new[p] for p in at]]
    assert {"[MASK]"} < set(changed)
