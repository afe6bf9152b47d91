"""Word pieces, vocabulary training and training records against plain Python."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from textmatch.operators import pretraining as P, tokens as K, vocabulary as V
from textmatch.options import DEFAULTS, SPECIAL_TOKENS
from textmatch.plans import training_data

PIECES = ["a", "b", "ab", "abc", "##a", "##b", "##c", "##bc", "##cab", "c"]


def vocabulary(spark, tokens):
    return spark.createDataFrame([(t, i) for i, t in enumerate([*SPECIAL_TOKENS, *tokens])], "token string, id int")


def greedy(word, vocab):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return ["[UNK]"]
    return out


def test_word_pieces(spark):
    rng = random.Random(1)
    words = {"".join(rng.choices("abcx", k=rng.randint(1, 9))) for _ in range(300)} | {"a" * 201, "a" * 200}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n int")
    for r in K.word_pieces(df, vocabulary(spark, PIECES)).collect():
        want = ["[UNK]"] if len(r.word) > 200 else greedy(r.word, set(PIECES))
        assert r.pieces == want and len(r.ids) == len(want)


def test_tokenize_keeps_empty_texts(spark):
    df = spark.createDataFrame([(1, 0, "ab c"), (1, 1, ""), (2, 0, "abc!")], "doc_id int, pos int, sentence string")
    got = {(r.doc_id, r.pos): r.tokens for r in K.tokenize(df, vocabulary(spark, PIECES)).collect()}
    assert got == {(1, 0): ["ab", "c"], (1, 1): [], (2, 0): ["abc", "[UNK]"]}


def naive_training(counts, size):
    """One merge at a time."""
    forms = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in counts}
    vocab = list(SPECIAL_TOKENS) + sorted({t for f in forms.values() for t in f})
    while len(vocab) < size:
        pairs = {}
        for w, f in forms.items():
            for x in zip(f, f[1:]):
                pairs[x] = pairs.get(x, 0) + counts[w]
        pairs = {p: n for p, n in pairs.items() if n >= 2}
        if not pairs:
            break
        at = {t: i for i, t in enumerate(vocab)}
        best = min(pairs, key=lambda p: (-pairs[p], max(at[p[0]], at[p[1]]), at[p[0]], at[p[1]]))
        new = best[0] + best[1].removeprefix("##")
        if new not in at:
            vocab.append(new)
        for w, f in forms.items():
            out, i = [], 0
            while i < len(f):
                if tuple(f[i : i + 2]) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(f[i])
                    i += 1
            forms[w] = out
    return vocab


def test_batched_merges_equal_single_merges(spark):
    rng = random.Random(5)
    parts = ["ba", "na", "ka", "tu", "aa", "lo", "mi", "ra"]
    counts = {}
    for _ in range(400):
        w = "".join(rng.choices(parts, k=rng.randint(1, 4)))
        counts[w] = counts.get(w, 0) + 1
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = V.train_vocabulary(df, replace(DEFAULTS, vocab_size=70)).orderBy("id").collect()
    assert [r.token for r in got] == naive_training(counts, 70)


def test_chunk_plan_covers_the_document(spark):
    rng = random.Random(2)
    docs = {doc: [rng.randint(1, 30) for _ in range(rng.randint(1, 40) if doc else 3000)] for doc in range(200)}
    lengths = spark.createDataFrame([(d, d, lens) for d, lens in docs.items()], "doc_id bigint, rank bigint, lens array<int>")
    planned = P.plan_chunks(lengths, replace(DEFAULTS, max_seq_length=43, dupe_factor=2))
    assert "Python" not in planned._jdf.queryExecution().toString()
    plans = {}
    for r in sorted(planned.collect(), key=lambda r: r.start):
        plans.setdefault((r.round, r.doc_id), []).append(r)
    assert len(plans) == 400
    for (_, doc), plan in plans.items():
        lens, expected = docs[doc], 0
        for r in plan:
            assert r.start == expected and r.start < r.a_end <= r.end
            assert r.end == len(lens) or sum(lens[r.start : r.end]) >= r.target
            assert sum(lens[r.start : r.end - 1]) < r.target
            assert r.is_random_next or r.a_end < r.end
            expected = r.a_end if r.is_random_next else r.end
        assert expected == len(lens)


def test_training_records(spark):
    rng = random.Random(9)
    rows = [
        (d, s, " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 30))))
        for d in range(1, 13)
        for s in range(rng.randint(1, 9) if d > 1 else 300)  # one document far longer than the rest
    ]
    lines = spark.createDataFrame(rows, "doc_id bigint, seg_no int, line string")
    vocab = vocabulary(spark, PIECES)
    options = replace(DEFAULTS, max_seq_length=32, max_predictions=5, dupe_factor=2)
    segs = K.tokenize(lines, vocab, ("doc_id", "seg_no"), "line").drop("ids")
    masked = training_data.instances(segs, vocab, options).cache()
    for r in masked.collect():
        assert len(r.tokens) <= 32 and 1 <= len(r.masked_lm_positions) <= 5
        whole = list(r.tokens)  # a random replacement may be any token, so restore first
        for p, label in zip(r.masked_lm_positions, r.masked_lm_labels):
            whole[p] = label
        assert whole[0] == "[CLS]" and whole.count("[SEP]") == 2 and whole[-1] == "[SEP]"
        assert not {"[CLS]", "[SEP]"} & set(r.masked_lm_labels)
        assert r.masked_lm_positions == sorted(r.masked_lm_positions)
        assert len(r.segment_ids) == len(r.tokens)
    ids = {r.token: r.id for r in vocab.collect()}
    records = training_data.records(masked, vocab, 3, options).collect()
    assert len(records) == masked.count()
    assert sorted(r.position for r in records) == list(range(len(records)))
    for r in records:
        assert len(r.input_ids) == len(r.input_mask) == len(r.segment_ids) == 32
        assert len(r.masked_lm_positions) == len(r.masked_lm_ids) == len(r.masked_lm_weights) == 5
        assert r.shard == r.position % 3 and ids["[MASK]"] < len(ids)


def test_other_document_is_never_the_same(spark):
    lengths = spark.createDataFrame([(d, [3] * 20) for d in range(5)], "doc_id bigint, lens array<int>")
    ranked = P.ranked_documents(lengths, 42)
    plan = P.plan_chunks(ranked, replace(DEFAULTS, max_seq_length=12, dupe_factor=8)).filter("is_random_next")
    drawn = P.other_document(plan, ranked, 42)
    assert drawn.count() == plan.count() and drawn.filter("b_doc = doc_id").count() == 0
    assert {r.b_doc for r in drawn.select(F.col("b_doc")).distinct().collect()} == set(range(5))
