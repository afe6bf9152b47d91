"""Vocabulary training on all documents; single merges in SQL on a small table."""

import random
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.operators import tokens as K, vocabulary as V
from textmatch.options import DEFAULTS, SPECIAL_TOKENS
from textmatch.queries import load
from textmatch.queries.common import sql_occurrences

# All merges in SQL, one a step: words are strings of one character per symbol, as in the
# operator. A table with few words keeps the recursion short; the rules are the same.
_TRAIN = f"""{sql_occurrences('benchmark', 'item_id', 'text', 'item_words')},
item_counts AS (SELECT word, count(*) AS n FROM item_words GROUP BY word),
item_chars AS (SELECT word, n, unnest(string_split(word, '')) AS ch, generate_subscripts(string_split(word, ''), 1) AS i FROM item_counts),
item_alphabet AS (SELECT ch FROM item_chars GROUP BY ch ORDER BY sum(n) DESC, ch LIMIT {DEFAULTS.max_alphabet}),
item_kept AS (SELECT c.*, row_number() OVER (PARTITION BY c.word ORDER BY c.i) AS k FROM item_chars c JOIN item_alphabet USING (ch)),
item_forms AS (SELECT word, n, k, CASE WHEN k = 1 THEN ch ELSE '##' || ch END AS t FROM item_kept),
first_tokens AS (SELECT flatten([[{', '.join(f"'{t}'" for t in SPECIAL_TOKENS)}], (SELECT list(t ORDER BY t) FROM (SELECT DISTINCT t FROM item_forms))]) AS toks),
first_words AS (SELECT word, any_value(n) AS n, string_agg(chr(CAST(255 + list_position(toks, t) AS INTEGER)), '' ORDER BY k) AS s FROM item_forms, first_tokens GROUP BY word),
train(step, ws, toks) AS (
    SELECT 0, (SELECT list({{'s': s, 'n': n}}) FROM first_words), toks FROM first_tokens
    UNION ALL
    SELECT step + 1, list_transform(ws, lambda w: {{'s': replace(w.s, pair, chr(CAST(255 + CASE WHEN place IS NULL THEN len(toks) + 1 ELSE place END AS INTEGER))), 'n': w.n}}),
        CASE WHEN place IS NULL THEN list_append(toks, joined) ELSE toks END
    FROM (SELECT *, list_position(toks, joined) AS place FROM (
        SELECT *, toks[ascii(pair[1]) - 255] || regexp_replace(toks[ascii(pair[2]) - 255], '^##', '') AS joined FROM (
            SELECT step, ws, toks, (SELECT pair FROM (
                SELECT w.s[i:i + 1] AS pair, w.n AS n FROM (SELECT w, unnest(range(1, length(w.s))) AS i FROM (SELECT unnest(ws) AS w)))
                GROUP BY pair HAVING sum(n) >= {DEFAULTS.min_frequency} ORDER BY sum(n) DESC, greatest(pair[1], pair[2]), pair LIMIT 1) AS pair
            FROM train) WHERE pair IS NOT NULL AND len(toks) < {DEFAULTS.vocab_size})))"""
_SQL = (
    f"WITH RECURSIVE {_TRAIN} SELECT unnest(toks) AS token, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS id "
    "FROM (SELECT toks FROM train ORDER BY step DESC LIMIT 1)"
)


def texts(seed, count):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(3, 8))) for _ in range(60)]
    return [" ".join(draw.choice(stems) + draw.choice(("", "s", "ing", "er")) for _ in range(40)) for _ in range(count)]


def test_all_merges_as_in_sql(spark, tmp_path):
    items = spark.createDataFrame(list(enumerate(texts(5, 12))), "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = V.train_vocabulary(K.word_counts(K.words_of(items, ["item_id"], "text")))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
        want = db.execute(_SQL).fetchall()
    assert len(want) > 150 and sorted(map(tuple, got.collect())) == sorted(want)


def test_query_learns_from_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts(6, 10))], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zzz zzz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["token"] for r in load()[0]["a14_train_vocabulary"](spark, str(tmp_path)).collect()}
    often = K.word_counts(K.words_of(docs, ["doc_id"], "text")).filter(F.col("n") >= 2)
    assert {r["word"] for r in often.collect()} <= got
    assert "zzz" not in got


def single_merges(counts, size):
    """One merge after the other, in plain Python."""
    tokens = list(SPECIAL_TOKENS) + sorted({c if i == 0 else "##" + c for w in counts for i, c in enumerate(w)})
    at = {t: i for i, t in enumerate(tokens)}
    words = [([at[c if i == 0 else "##" + c] for i, c in enumerate(w)], n) for w, n in counts.items()]
    while len(tokens) < size:
        pairs = {}
        for ids, n in words:
            for p in zip(ids, ids[1:]):
                pairs[p] = pairs.get(p, 0) + n
        pairs = {p: n for p, n in pairs.items() if n >= DEFAULTS.min_frequency}
        if not pairs:
            break
        pair = min(pairs, key=lambda p: (-pairs[p], max(p), p))
        joined = V.join_symbols(tokens[pair[0]], tokens[pair[1]])
        if joined not in at:
            at[joined] = len(tokens)
            tokens.append(joined)
        for ids, _ in words:
            i = 0
            while i < len(ids) - 1:
                if (ids[i], ids[i + 1]) == pair:
                    ids[i : i + 2] = [at[joined]]
                i += 1
    return tokens


@pytest.mark.parametrize("seed, letters, longest, size", [
    (2, "aaab", 20, 200), (4, "abcdefgh", 7, 90), (5, "ab", 30, 60),
])
def test_rounds_give_the_result_of_single_merges(spark, seed, letters, longest, size):
    """Few letters: many ties, runs of one letter, and merges that give a token twice."""
    draw = random.Random(seed)
    counts = {"".join(draw.choice(letters) for _ in range(draw.randint(1, longest))): draw.randint(1, 6) for _ in range(60)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = V.train_vocabulary(table, replace(DEFAULTS, vocab_size=size), batch=draw.choice((3, 40, 10_000)))
    assert [r["token"] for r in got.orderBy("id").collect()] == single_merges(counts, size)


def test_counts_follow_from_changes(spark):
    """Counts kept up by changes equal counts of the merged words."""
    draw = random.Random(9)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(200)]
    table = spark.createDataFrame([(w, draw.randint(1, 9)) for w in words], "word string, n long")
    ids = V._as_ids(V.first_symbols(table)[0])
    before = {r["pair"]: r["n"] for r in V._totals(V._pair_changes(ids, None), "pairs").collect()}
    a, b = sorted(before, key=before.get)[-2:]
    first = (np.array([a]), np.array([500]))
    rounds = [first, (np.array(sorted({500 << 32 | b & 0xFFFFFFFF, b >> 32 << 32 | 500})), np.array([501, 502]))]
    changed = V._totals(V._pair_changes(ids, None).unionByName(V._pair_changes(ids, rounds)), "pairs")
    whole = V._totals(V._pair_changes(V._merged(ids, rounds), None), "pairs")
    assert sorted(map(tuple, changed.collect())) == sorted(map(tuple, whole.collect()))


def test_no_merge_beyond_the_room():
    """Tokens behind the last place are not made, and pairs too rare for it are not asked for."""
    state = V.Merges(list("abcdef"), 1)
    chosen, undone = state.choose([(0, 1, 9), (2, 3, 8), (4, 5, 7)])
    assert (list(chosen), undone) == ([(0, 1)], False)
    assert state.least() == 9


def test_whole_counts_reach_the_driver(spark):
    """A count that is cut waits; one that alone is too long is cut by the symbols' age."""
    state = V.Merges(list("abcd"), 9)
    rows = [(0 << 32 | 1, 5), (1 << 32 | 0, 7), (2 << 32 | 1, 5), (0 << 32 | 2, 5), (3 << 32 | 3, 1)]
    pairs = spark.createDataFrame(rows, "pair long, n long")
    assert V._top(pairs, state, 9) == [(1, 0, 7), (0, 1, 5), (0, 2, 5), (2, 1, 5), (3, 3, 1)]
    assert V._top(pairs, state, 3) == [(1, 0, 7)]
    assert V._top(pairs.filter("n = 5"), state, 2) == [(0, 1, 5), (0, 2, 5)]
    assert V._top(pairs.filter("n > 9"), state, 2) == []
