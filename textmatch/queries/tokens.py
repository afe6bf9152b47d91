"""Vocabulary, word pieces and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import pad
from ..operators import encoding as E, pretraining as P, records as R, tokens as K, vocabulary as V
from ..plans.model import hashed_token_model
from ..session import written
from .common import (
    SQL_VOCAB, demo_vocabulary, query, sql_occurrences, sql_pieces, sql_tokens, sql_words, table,
)
from .texts import LINES

TURNS = ("conversations", "conv_id, turn", "text")
TURN_KEYS = ["conv_id", "turn"]
TOKENS = "WITH RECURSIVE " + sql_tokens(*TURNS)


def turn_tokens(spark, sf):
    """Word pieces of all conversation turns (conv_id, turn, tokens, ids)."""
    return K.tokenize(table(spark, sf, "conversations"), demo_vocabulary(spark, sf), TURN_KEYS, "text")


def doc_word_counts(spark, sf):
    parts = K.part_counts(table(spark, sf, "documents"), "text")
    return K.word_counts(K.words_of(parts, ["n"], "part"), weight="n")


def stored_word_counts(spark, sf):
    """The same for queries that read them more than once."""
    return written(doc_word_counts(spark, sf), "counts")


_DOC_WORDS = sql_occurrences("documents", "doc_id", "text", "occ")
_COUNTS = f"{_DOC_WORDS}, counts AS (SELECT word, count(*) AS n FROM occ GROUP BY word)"


@query("j9_longest_matches", f"WITH RECURSIVE {SQL_VOCAB}, {_DOC_WORDS}, {sql_pieces('occ')} "
       "SELECT m.word, CAST(m.s AS INTEGER) AS start, CAST(m.l AS INTEGER) AS len, v.id FROM pieces_match m "
       "JOIN vocab v ON v.token = CASE WHEN m.s > 1 THEN '##' ELSE '' END || substring(m.word, m.s, m.l)")
def j9(spark, sf):
    return K.vocabulary_matches(doc_word_counts(spark, sf), demo_vocabulary(spark, sf))


@query("t11_word_pieces", f"WITH RECURSIVE {SQL_VOCAB}, {_DOC_WORDS}, {sql_pieces('occ')} SELECT word, array_to_string(pieces, ' ') AS pieces FROM pieces")
def t11(spark, sf):
    pieces = K.word_pieces(stored_word_counts(spark, sf), demo_vocabulary(spark, sf))
    return pieces.select("word", F.array_join("pieces", " ").alias("pieces"))


@query("t12_tokenize", f"{TOKENS} SELECT conv_id, turn, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, ' ') AS tokens FROM toks")
def t12(spark, sf):
    toks = turn_tokens(spark, sf)
    return toks.select(*TURN_KEYS, F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(
    "t12_tokenize_documents",
    "WITH RECURSIVE " + sql_tokens("documents", "doc_id", "text")
    + " SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n, md5(array_to_string(tokens, ' ')) AS tokens FROM toks",
)
def t12_documents(spark, sf):
    toks = K.tokenize(table(spark, sf, "documents"), demo_vocabulary(spark, sf), ["doc_id"], "text")
    return toks.select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens"))


_IDS = """, flat AS (SELECT conv_id, turn, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM toks)"""


@query("j5_tokens_to_ids", f"{TOKENS}{_IDS} SELECT conv_id, turn, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS ids FROM flat JOIN vocab USING (token) GROUP BY conv_id, turn")
def j5(spark, sf):
    vocab = demo_vocabulary(spark, sf)
    toks = K.tokenize(table(spark, sf, "conversations"), vocab, TURN_KEYS, "text").drop("ids")
    ids = K.tokens_to_ids(toks.filter(F.size("tokens") > 0), vocab, TURN_KEYS)
    return ids.select(*TURN_KEYS, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("j6_ids_to_tokens", f"{TOKENS} SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens FROM toks WHERE len(tokens) > 0")
def j6(spark, sf):
    vocab = demo_vocabulary(spark, sf)
    toks = K.tokenize(table(spark, sf, "conversations"), vocab, TURN_KEYS, "text").drop("tokens")
    back = K.ids_to_tokens(toks.filter(F.size("ids") > 0), vocab, TURN_KEYS)
    return back.select(*TURN_KEYS, F.array_join("tokens", " ").alias("tokens"))


@query("p8_no_empty_lists", f"{TOKENS} SELECT conv_id, turn, CAST(len(tokens) AS INTEGER) AS n FROM toks WHERE len(tokens) > 0")
def p8(spark, sf):
    return turn_tokens(spark, sf).filter(F.size("tokens") > 0).select(*TURN_KEYS, F.size("tokens").alias("n"))


_WORDS = """, cand AS (SELECT conv_id, turn, i, token FROM flat WHERE token NOT IN ('[CLS]', '[SEP]')),
starts AS (SELECT *, CASE WHEN token NOT LIKE '##%' OR row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) = 1 THEN 1 ELSE 0 END AS s FROM cand),
grouped AS (SELECT *, sum(s) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM starts)"""


@query(
    "w6_whole_words",
    f"{TOKENS}{_IDS}{_WORDS} SELECT conv_id, turn, CAST(g - 1 AS INTEGER) AS word_no, CAST(min(i) - 1 AS INTEGER) AS first_pos, CAST(count(*) AS INTEGER) AS n FROM grouped GROUP BY conv_id, turn, g",
)
def w6(spark, sf):
    groups = turn_tokens(spark, sf).select(*TURN_KEYS, F.posexplode(P.whole_words(F.col("tokens"))).alias("word_no", "g"))
    return groups.select(*TURN_KEYS, "word_no", F.element_at("g", 1).alias("first_pos"), F.size("g").alias("n"))


# ---- model inputs: a turn's role and its text form the pair -----------------------

PAIRS = (
    "WITH RECURSIVE sides AS (SELECT conv_id, turn, 0 AS side, role AS text FROM conversations "
    "UNION ALL SELECT conv_id, turn, 1, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') FROM conversations), "
    + sql_tokens("sides", "conv_id, turn, side", "text")
    + """,
halves AS (SELECT a.conv_id, a.turn, a.tokens AS a, b.tokens AS b FROM toks a JOIN toks b USING (conv_id, turn) WHERE a.side = 0 AND b.side = 1)"""
)
_KEPT_A = "CASE WHEN len(a) + len(b) <= {t} THEN len(a) ELSE least(len(a), greatest(CAST(ceil({t} / 2.0) AS BIGINT), {t} - len(b))) END"
INPUTS = (
    PAIRS
    + f""",
sized AS (SELECT *, CASE WHEN len(b) = 0 THEN least(len(a), 126) ELSE {_KEPT_A.format(t=125)} END AS ka FROM halves),
cut AS (SELECT conv_id, turn, a[1:ka] AS a, b[1:least(len(b), 125 - ka)] AS b FROM sized),
inputs AS (SELECT conv_id, turn, flatten([['[CLS]'], a, ['[SEP]'], b, CASE WHEN len(b) > 0 THEN ['[SEP]'] ELSE [] END]) AS tokens,
    flatten([list_transform(range(0, len(a) + 2), lambda x: 0), list_transform(range(0, len(b) + CASE WHEN len(b) > 0 THEN 1 ELSE 0 END), lambda x: 1)]) AS types FROM cut),
in_flat AS (SELECT conv_id, turn, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM inputs),
in_ids AS (SELECT conv_id, turn, list(id ORDER BY i) AS ids FROM in_flat JOIN vocab USING (token) GROUP BY conv_id, turn)"""
)


def pair_texts(spark, sf):
    text = F.concat(F.col("role"), F.lit(" ||| "), F.replace("text", F.lit("\n"), F.lit(" ")))
    return table(spark, sf, "conversations").select(*TURN_KEYS, text.alias("text"))


def model_inputs(spark, sf):
    return E.encode_texts(pair_texts(spark, sf), demo_vocabulary(spark, sf), TURN_KEYS, "text")


def _joined(name: str):
    return F.array_join(F.col(name).cast("array<string>"), " ").alias(name)


def _sql_padded(x: str, filler: str = "0") -> str:
    return f"array_to_string(flatten([{x}, list_transform(range(0, 128 - len({x})), lambda z: {filler})]), ' ')"


@query(
    "t14_model_inputs",
    f"{INPUTS} SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens, {_sql_padded('ids')} AS input_ids, "
    f"{_sql_padded('list_transform(ids, lambda q: 1)')} AS input_mask, {_sql_padded('types')} AS input_type_ids "
    "FROM inputs JOIN in_ids USING (conv_id, turn)",
)
def t14(spark, sf):
    rows = model_inputs(spark, sf)
    return rows.select(*TURN_KEYS, *[_joined(c) for c in ("tokens", "input_ids", "input_mask", "input_type_ids")])


@query(
    "t15_truncated_pairs",
    f"""WITH pairs AS (SELECT a.conv_id, a.turn, {sql_words('a.text')} AS a, {sql_words('b.text')} AS b
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    sized AS (SELECT *, {_KEPT_A.format(t=60)} AS ka FROM pairs)
    SELECT conv_id, turn, CAST(ka AS INTEGER) AS len_a, CAST(CASE WHEN len(a) + len(b) <= 60 THEN len(b) ELSE least(len(b), 60 - ka) END AS INTEGER) AS len_b FROM sized""",
)
def t15(spark, sf):
    from ..functions.unicode import basic_tokens

    turns = table(spark, sf, "conversations").select(*TURN_KEYS, basic_tokens(F.col("text")).alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    len_a, len_b = E.kept_lengths(F.size("a"), F.size("b"), 60)
    return turns.join(after, TURN_KEYS).select(*TURN_KEYS, len_a.alias("len_a"), len_b.alias("len_b"))


@query(
    "w8_sequence_numbers",
    f"WITH {LINES}, kept AS (SELECT * FROM raw WHERE trim(line) <> '') SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS unique_id, line FROM kept",
)
def w8(spark, sf):
    kept = F.filter(F.split("text", "\n", -1), lambda s: F.trim(s) != "")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(kept).alias("unique_id", "line"))


DIM = 16
# The stand-in model in SQL: vectors depend on the token id only.
SQL_MODEL = f"""
model AS (SELECT id, token, list_transform(range(0, {DIM}), lambda j: CAST(
    ((id * 7919 + j * j * 104729 + (id % 97) * (j + 1) * 15485863) % 10007) / CAST(5003.5 AS DOUBLE) - 1.0 AS FLOAT)) AS v
    FROM (SELECT CAST(id AS BIGINT) AS id, token FROM vocab))"""


@query(
    "k4_embed",
    f"{INPUTS}, {SQL_MODEL} SELECT f.conv_id, f.turn, CAST(f.i - 1 AS INTEGER) AS tok, f.token, round(CAST(v[1] AS DOUBLE), 5) AS first, "
    "round(list_sum(CAST(v AS DOUBLE[])), 4) AS total FROM in_flat f JOIN model USING (token)",
)
def k4(spark, sf):
    features = E.embed(model_inputs(spark, sf), hashed_token_model(DIM))
    flat = features.select(*TURN_KEYS, F.posexplode("features").alias("tok", "f"))
    values = F.element_at(F.col("f.layers"), 1)["values"]
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return flat.select(
        *TURN_KEYS, "tok", F.col("f.token").alias("token"), F.round(F.element_at(values, 1), 5).alias("first"), F.round(total, 4).alias("total")
    )


@query(
    "j7_attach_outputs",
    f"{INPUTS}, {SQL_MODEL} SELECT f.conv_id, f.turn, f.token, round(CAST(v[2] AS DOUBLE), 5) AS second FROM in_flat f JOIN model USING (token)",
)
def j7(spark, sf):
    inputs = model_inputs(spark, sf)
    # One padded vector per input place, as a model returns them.
    place = F.transform("input_ids", lambda i: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda j: F.pmod(
        i.cast("bigint") * 7919 + j * j * 104729 + (i % 97) * (j + 1).cast("bigint") * 15485863, F.lit(10007)) / 5003.5 - 1.0))
    outputs = inputs.select(*TURN_KEYS, place.alias("vectors"))
    rows = E.attach_outputs(inputs, outputs, TURN_KEYS)
    return rows.select(*TURN_KEYS, "token", F.round(F.element_at("values", 2).cast("float").cast("double"), 5).alias("second"))


@query(
    "r5_pad_positions",
    f"{TOKENS}, short AS (SELECT conv_id, turn, tokens[1:20] AS t FROM toks) SELECT conv_id, turn, "
    "array_to_string(flatten([list_transform(t, lambda x: length(x)), list_transform(range(0, 20 - len(t)), lambda x: 0)]), ' ') AS out FROM short",
)
def r5(spark, sf):
    lengths = F.transform(F.slice("tokens", 1, 20), lambda t: F.length(t))
    padded = pad(lengths, 20, F.lit(0)).cast("array<string>")
    return turn_tokens(spark, sf).select(*TURN_KEYS, F.array_join(padded, " ").alias("out"))


# ---- vocabulary training ------------------------------------------------------------


@query("a14_word_counts", f"WITH {_COUNTS} SELECT * FROM counts")
def a14_counts(spark, sf):
    return doc_word_counts(spark, sf)


_LETTERS = f"""{_COUNTS}, chars AS (SELECT word, n, unnest(string_split(word, '')) AS ch, generate_subscripts(string_split(word, ''), 1) AS i FROM counts),
alphabet AS (SELECT ch, CAST(sum(n) AS BIGINT) AS n FROM chars GROUP BY ch ORDER BY n DESC, ch LIMIT 1000)"""


@query("a14_alphabet", f'WITH {_LETTERS} SELECT ch AS "char", n FROM alphabet')
def a14_alphabet(spark, sf):
    return V.alphabet(doc_word_counts(spark, sf))


_PAIRS = f"""{_LETTERS}, kept AS (SELECT c.word, c.n, c.ch, row_number() OVER (PARTITION BY c.word ORDER BY c.i) AS i FROM chars c JOIN alphabet USING (ch)),
symbols AS (SELECT word, n, i, CASE WHEN i = 1 THEN ch ELSE '##' || ch END AS s FROM kept),
nexts AS (SELECT s AS "left", lead(s) OVER (PARTITION BY word ORDER BY i) AS "right", n FROM symbols)"""


@query("a14_first_pairs", f'WITH {_PAIRS} SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM nexts WHERE "right" IS NOT NULL GROUP BY ALL')
def a14_pairs(spark, sf):
    symbols, tokens = V.first_symbols(stored_word_counts(spark, sf))
    rows = [(V.symbol(i), t) for i, t in enumerate(tokens)]
    names = spark.createDataFrame(rows, "symbol string, token string")
    pairs = V.pair_counts(symbols).select(
        F.substring("pair", 1, 1).alias("l"), F.substring("pair", 2, 1).alias("r"), "n"
    )
    left = names.select(F.col("symbol").alias("l"), F.col("token").alias("left"))
    right = names.select(F.col("symbol").alias("r"), F.col("token").alias("right"))
    return pairs.join(left, "l").join(right, "r").select("left", "right", "n")


@query("a14_train_vocabulary")
def a14_train(spark, sf):
    return V.train_vocabulary(stored_word_counts(spark, sf))


@query("r1_flatten", f"WITH lists AS (SELECT doc_id, [{sql_words('text')}, [lang, source]] AS l FROM documents) SELECT doc_id, CAST(len(flatten(l)) AS INTEGER) AS n, md5(array_to_string(flatten(l), ' ')) AS out FROM lists")
def r1(spark, sf):
    from ..functions.unicode import basic_tokens

    nested = F.array(basic_tokens(F.col("text")), F.array("lang", "source"))
    flat = table(spark, sf, "documents").select("doc_id", F.flatten(nested).alias("f"))
    return flat.select("doc_id", F.size("f").alias("n"), F.md5(F.array_join("f", " ")).alias("out"))


@query("p2_only_key", "SELECT doc_id, lang AS value, CAST(1 AS INTEGER) AS n FROM documents")
def p2(spark, sf):
    both = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    kept = R.only_key(both, "lang")
    return table(spark, sf, "documents").select("doc_id", F.element_at(kept, "lang").alias("value"), F.size(kept).alias("n"))
