"""Positions, training data and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import metrics as Z
from ..operators import evaluation as V, pretraining as P, positions as G
from ..operators.vocabulary import number_tokens
from ..options import DEFAULTS, SPECIAL_TOKENS
from ..plans import training_data
from ..session import fresh_path, written
from ..sources import readers, writers
from .common import demo_vocabulary, query, sql_tokens, table

SEED, ROUNDS = 42, DEFAULTS.dupe_factor
OPTIONS = replace(DEFAULTS, dupe_factor=ROUNDS)
LIMIT = OPTIONS.max_seq_length - 3


def u(*keys: str) -> str:
    """The uniform draw of the library in SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(keys)})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def h(*keys: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(keys)}))"


# ---- positions -----------------------------------------------------------------------

_ORDERS = "pos AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)"


def ordered(spark, sf):
    return G.position_by_id(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("w4_near_equal_runs", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS run FROM orders")
def w4(spark, sf):
    return G.near_equal_runs(ordered(spark, sf), 7).select("o_orderkey", "run")


@query("w5_chunks", f"WITH {_ORDERS} SELECT o_orderkey, position // 32 AS chunk FROM pos")
def w5(spark, sf):
    return G.chunks(ordered(spark, sf), 32).select("o_orderkey", "chunk")


@query("w5_full_chunks", f"WITH {_ORDERS} SELECT position // 32 AS chunk, count(*) AS n FROM pos GROUP BY ALL HAVING count(*) = 32")
def w5_full(spark, sf):
    return G.full_chunks(ordered(spark, sf), 32).groupBy("chunk").agg(F.count("*").alias("n"))


@query("w7_round_robin", f"WITH {_ORDERS} SELECT o_orderkey, CAST(position % 4 AS INTEGER) AS shard FROM pos")
def w7(spark, sf):
    return G.shards(ordered(spark, sf), 4).select("o_orderkey", "shard")


@query(
    "o2_seeded_shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {h(chr(39) + 'order' + chr(39), 'doc_id')}, doc_id) - 1 AS position FROM documents",
)
def o2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return P.shuffled(docs, SEED, ["doc_id"], "order").select("doc_id", "position")


@query(
    "o5_first_batches",
    f"WITH {_ORDERS} SELECT position // 8 AS chunk, count(*) AS n FROM pos WHERE position // 8 < 100 GROUP BY ALL",
)
def o5(spark, sf):
    # Evaluation looks at a fixed number of batches: the limit is the feature.
    kept = G.chunks(ordered(spark, sf), 8).filter(F.col("chunk") < 100)
    return kept.groupBy("chunk").agg(F.count("*").alias("n"))


@query("u2_repeat_corpus", f"SELECT doc_id, CAST(round AS INTEGER) AS round FROM documents, range({ROUNDS}) AS r(round)")
def u2(spark, sf):
    return P.rounds(table(spark, sf, "documents").select("doc_id"), ROUNDS)


# ---- training data ------------------------------------------------------------------------
# Tokens are the blank-separated words of the lines, cut to pieces of five letters, so that
# the queries check the planning and masking apart from tokenisation.

SQL_SEGS = """
lines AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
line_words AS (SELECT doc_id, i, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM lines),
segs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS seg_no,
    flatten(list_transform(ws, lambda w: list_transform(range(0, (length(w) + 4) // 5),
        lambda k: CASE WHEN k > 0 THEN '##' ELSE '' END || substring(w, 5 * k + 1, 5)))) AS tokens
    FROM line_words WHERE len(ws) > 0),
lengths AS (SELECT doc_id, list(len(tokens) ORDER BY seg_no) AS lens, count(*) AS n_segs FROM segs GROUP BY doc_id),
ranks AS (SELECT doc_id, lens, n_segs, row_number() OVER (ORDER BY """ + h("'order'", "doc_id") + """, doc_id) - 1 AS rank FROM lengths)"""


def line_pieces(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("seg_no", "line"))
    pieces = F.split(F.regexp_replace("line", "([^ ]{5})(?=[^ ])", "$1 ##"), " ", -1)
    return lines.select("doc_id", "seg_no", F.array_remove(pieces, "").alias("tokens"))


def segs(spark, sf):
    return P.numbered_segments(line_pieces(spark, sf))


def ranked(spark, sf):
    return P.ranked_documents(P.document_lengths(segs(spark, sf)), SEED)


@query("g0_segment_lengths", f"WITH {SQL_SEGS} SELECT doc_id, rank, array_to_string(lens, ' ') AS lens FROM ranks")
def g0(spark, sf):
    return ranked(spark, sf).select("doc_id", "rank", F.array_join(F.col("lens").cast("array<string>"), " ").alias("lens"))


_TARGET = f"CASE WHEN {u(chr(39) + 'is_short' + chr(39), 'round', 'doc_id')} < 0.1 THEN 2 + CAST(floor({u(chr(39) + 'short' + chr(39), 'round', 'doc_id')} * {LIMIT - 1}) AS BIGINT) ELSE {LIMIT} END"
SQL_TARGETS = f"{SQL_SEGS}, targets AS (SELECT doc_id, rank, lens, n_segs, CAST(round AS INTEGER) AS round, CAST({_TARGET} AS INTEGER) AS target FROM ranks, range({ROUNDS}) AS r(round))"


@query("g1_target_length", f"WITH {SQL_TARGETS} SELECT round, doc_id, target FROM targets")
def g1(spark, sf):
    rounds = P.rounds(ranked(spark, sf), ROUNDS)
    return rounds.select("round", "doc_id", P.target_length(SEED, LIMIT, OPTIONS.short_seq_prob).alias("target"))


# The chunk walk: each step finds the end of the chunk at `start` and the next start.
SQL_PLAN = f"""{SQL_TARGETS},
cum AS (SELECT doc_id, seg_no, sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY seg_no) AS upto FROM segs),
ends AS (SELECT t.round, t.doc_id, t.rank, t.target, c.seg_no AS start,
    coalesce((SELECT min(e.seg_no) + 1 FROM cum e WHERE e.doc_id = t.doc_id AND e.seg_no >= c.seg_no AND e.seg_no < c.seg_no + t.target
        AND e.upto - c.upto + t.lens[c.seg_no + 1] >= t.target), t.n_segs) AS "end", t.n_segs
    FROM targets t JOIN cum c USING (doc_id)),
steps AS (SELECT *, start + 1 + CASE WHEN "end" - start >= 2 THEN CAST(floor({u("'a_end'", 'round', 'doc_id', 'start')} * ("end" - start - 1)) AS BIGINT) ELSE 0 END AS a_end,
    "end" - start = 1 OR {u("'random_next'", 'round', 'doc_id', 'start')} < 0.5 AS is_random_next FROM ends),
walk(round, doc_id, start) AS (
    SELECT round, doc_id, CAST(0 AS BIGINT) FROM targets
    UNION ALL
    SELECT w.round, w.doc_id, CASE WHEN s.is_random_next THEN s.a_end ELSE s."end" END FROM walk w JOIN steps s
        ON s.round = w.round AND s.doc_id = w.doc_id AND s.start = w.start
        WHERE CASE WHEN s.is_random_next THEN s.a_end ELSE s."end" END < s.n_segs),
plan AS (SELECT s.round, s.doc_id, s.rank, CAST(s.start AS INTEGER) AS start, CAST(s.a_end AS INTEGER) AS a_end, CAST(s."end" AS INTEGER) AS "end", s.target, s.is_random_next
    FROM walk w JOIN steps s ON s.round = w.round AND s.doc_id = w.doc_id AND s.start = w.start)"""
_PLAN_COLUMNS = 'round, doc_id, rank, start, a_end, "end", target, is_random_next'


@query("g2_chunk_plan", f"WITH RECURSIVE {SQL_PLAN} SELECT {_PLAN_COLUMNS} FROM plan")
def g2(spark, sf):
    return P.plan_chunks(ranked(spark, sf), OPTIONS)


@query("w9_packed_sentences", f'WITH RECURSIVE {SQL_PLAN} SELECT round, doc_id, start, "end" - start AS n_segs FROM plan')
def w9(spark, sf):
    return g2(spark, sf).select("round", "doc_id", "start", (F.col("end") - F.col("start")).alias("n_segs"))


SQL_OTHER = f"""{SQL_PLAN},
counted AS (SELECT count(*) AS n FROM ranks),
drawn AS (SELECT p.*, (p.rank + 1 + CAST(floor({u("'other'", 'p.round', 'p.doc_id', 'p.start')} * greatest(n - 1, 1)) AS BIGINT)) % n AS other FROM plan p, counted WHERE p.is_random_next),
others AS (SELECT d.*, r.doc_id AS b_doc, CAST(floor({u("'b_start'", 'd.round', 'd.doc_id', 'd.start')} * r.n_segs) AS INTEGER) AS b_start FROM drawn d JOIN ranks r ON r.rank = d.other)"""


@query("j8_other_document", f"WITH RECURSIVE {SQL_OTHER} SELECT round, doc_id, start, b_doc, b_start FROM others")
def j8(spark, sf):
    documents = written(ranked(spark, sf), "documents")
    plan = P.plan_chunks(documents, OPTIONS).filter("is_random_next")
    return P.other_document(plan, documents, SEED).select("round", "doc_id", "start", "b_doc", "b_start")


# Text in place of token lists keeps the hash checks short.
SQL_PAIRS = f"""{SQL_OTHER},
a_side AS (SELECT p.round, p.doc_id, p.start, flatten(list(s.tokens ORDER BY s.seg_no)) AS a FROM plan p JOIN segs s
    ON s.doc_id = p.doc_id AND s.seg_no >= p.start AND s.seg_no < p.a_end GROUP BY ALL),
next_side AS (SELECT p.round, p.doc_id, p.start, flatten(list(s.tokens ORDER BY s.seg_no)) AS b FROM plan p JOIN segs s
    ON s.doc_id = p.doc_id AND s.seg_no >= p.a_end AND s.seg_no < p."end" WHERE NOT p.is_random_next GROUP BY ALL),
cand AS (SELECT o.round, o.doc_id, o.start, o.target - len(a.a) AS want, s.seg_no, s.tokens,
    sum(len(s.tokens)) OVER (PARTITION BY o.round, o.doc_id, o.start ORDER BY s.seg_no) - len(s.tokens) AS before
    FROM others o JOIN a_side a USING (round, doc_id, start) JOIN segs s ON s.doc_id = o.b_doc AND s.seg_no >= o.b_start AND s.seg_no < o.b_start + o.target),
random_side AS (SELECT round, doc_id, start, flatten(list(tokens ORDER BY seg_no)) AS b FROM cand WHERE before = 0 OR before < want GROUP BY ALL),
pairs AS (SELECT p.round, p.doc_id, p.start, p.is_random_next, a.a, coalesce(r.b, n.b) AS b FROM plan p JOIN a_side a USING (round, doc_id, start)
    LEFT JOIN random_side r USING (round, doc_id, start) LEFT JOIN next_side n USING (round, doc_id, start))"""


def plan_tables(spark, sf):
    tokens = P.stored_segments(line_pieces(spark, sf))
    documents = written(P.ranked_documents(P.document_lengths(tokens), SEED), "documents")
    return tokens, documents, written(P.plan_chunks(documents, OPTIONS), "plan")


def pairs(spark, sf):
    tokens, documents, plan = plan_tables(spark, sf)
    return P.sentence_pairs(plan, tokens, documents, OPTIONS)


def _text(name: str):
    return F.array_join(F.col(name).cast("array<string>"), " ")


@query(
    "g3_sentence_pairs",
    f"WITH RECURSIVE {SQL_PAIRS} SELECT round, doc_id, start, is_random_next, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b FROM pairs",
)
def g3(spark, sf):
    return pairs(spark, sf).select(
        "round", "doc_id", "start", "is_random_next", _text("tokens_a").alias("a"), _text("tokens_b").alias("b")
    )


def _front(side: str, n: str) -> str:
    draw = u(f"'front_{side}'", "round", "doc_id", "start", "i")
    return f"coalesce(list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN {draw} < 0.5 THEN 1 ELSE 0 END)), 0)"


SQL_TRUNCATED = f"""{SQL_PAIRS},
kept_a AS (SELECT *, CASE WHEN len(a) + len(b) <= {LIMIT} THEN len(a) ELSE least(len(a), greatest({-(-LIMIT // 2)}, {LIMIT} - len(b))) END AS ka FROM pairs),
kept AS (SELECT *, CASE WHEN len(a) + len(b) <= {LIMIT} THEN len(b) ELSE least(len(b), {LIMIT} - ka) END AS kb FROM kept_a),
fronts AS (SELECT *, {_front('a', '(len(a) - ka)')} AS fa, {_front('b', '(len(b) - kb)')} AS fb FROM kept),
cut AS (SELECT round, doc_id, start, is_random_next, a[CAST(fa + 1 AS BIGINT):CAST(fa + ka AS BIGINT)] AS a, b[CAST(fb + 1 AS BIGINT):CAST(fb + kb AS BIGINT)] AS b FROM fronts)"""


@query(
    "t16_truncated_randomly",
    f"WITH RECURSIVE {SQL_TRUNCATED} SELECT round, doc_id, start, array_to_string(a, ' ') AS a, array_to_string(b, ' ') AS b FROM cut",
)
def t16(spark, sf):
    rows = P.truncated(pairs(spark, sf), OPTIONS)
    return rows.select("round", "doc_id", "start", _text("tokens_a").alias("a"), _text("tokens_b").alias("b"))


SQL_ASSEMBLED = f"""{SQL_TRUNCATED},
inst AS (SELECT round, doc_id, start, is_random_next, flatten([['[CLS]'], a, ['[SEP]'], b, ['[SEP]']]) AS tokens,
    flatten([list_transform(range(0, len(a) + 2), lambda x: 0), list_transform(range(0, len(b) + 1), lambda x: 1)]) AS segment_ids FROM cut)"""


def instances(spark, sf):
    return P.assembled(P.truncated(pairs(spark, sf), OPTIONS))


@query(
    "g4_assembled",
    f"WITH RECURSIVE {SQL_ASSEMBLED} SELECT round, doc_id, start, array_to_string(tokens, ' ') AS tokens, array_to_string(segment_ids, ' ') AS segment_ids FROM inst",
)
def g4(spark, sf):
    return instances(spark, sf).select("round", "doc_id", "start", _text("tokens").alias("tokens"), _text("segment_ids").alias("segment_ids"))


@query(
    "m5_masked_count",
    f"WITH RECURSIVE {SQL_ASSEMBLED} SELECT round, doc_id, start, CAST(least(20, greatest(1, round_even(len(tokens) * CAST(0.15 AS DOUBLE), 0))) AS INTEGER) AS quota FROM inst",
)
def m5(spark, sf):
    return instances(spark, sf).select(
        "round", "doc_id", "start", P.masked_count(F.size("tokens"), OPTIONS).alias("quota")
    )


_WORD_GROUPS = f"""{SQL_ASSEMBLED},
flat AS (SELECT round, doc_id, start, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS i FROM inst),
heads AS (SELECT *, CASE WHEN token NOT LIKE '##%' OR row_number() OVER (PARTITION BY round, doc_id, start ORDER BY i) = 1 THEN 1 ELSE 0 END AS hd
    FROM flat WHERE token NOT IN ('[CLS]', '[SEP]')),
grp AS (SELECT *, sum(hd) OVER (PARTITION BY round, doc_id, start ORDER BY i) AS g FROM heads),
word_groups AS (SELECT round, doc_id, start, min(i) AS first, list(i ORDER BY i) AS ps FROM grp GROUP BY round, doc_id, start, g)"""


@query(
    "o3_shuffled_candidates",
    f"WITH RECURSIVE {_WORD_GROUPS} SELECT round, doc_id, start, string_agg(CAST(first AS VARCHAR), ' ' ORDER BY {h(chr(39) + 'mask' + chr(39), 'round', 'doc_id', 'start', 'first')}) AS words FROM word_groups GROUP BY ALL",
)
def o3(spark, sf):
    rows = P.shuffled_words(instances(spark, sf), OPTIONS)
    firsts = F.transform("words", lambda w: F.element_at(w, 1).cast("string"))
    return rows.select("round", "doc_id", "start", F.array_join(firsts, " ").alias("words"))


SQL_PICKED = f"""{_WORD_GROUPS},
quotas AS (SELECT round, doc_id, start, CAST(least(20, greatest(1, round_even(len(tokens) * CAST(0.15 AS DOUBLE), 0))) AS INTEGER) AS quota FROM inst),
ordered AS (SELECT w.*, row_number() OVER (PARTITION BY round, doc_id, start ORDER BY {h("'mask'", 'round', 'doc_id', 'start', 'first')}) AS k FROM word_groups w),
words_of AS (SELECT round, doc_id, start, list(len(ps) ORDER BY k) AS sizes FROM ordered GROUP BY ALL),
pick(round, doc_id, start, k, used, quota, sizes, taken) AS (
    SELECT round, doc_id, start, CAST(0 AS BIGINT), CAST(0 AS BIGINT), quota, sizes, FALSE FROM quotas JOIN words_of USING (round, doc_id, start)
    UNION ALL
    SELECT round, doc_id, start, k + 1, CASE WHEN used + sizes[k + 1] <= quota THEN used + sizes[k + 1] ELSE used END, quota, sizes,
        used + sizes[k + 1] <= quota FROM pick WHERE k < len(sizes) AND used < quota),
picked AS (SELECT o.round, o.doc_id, o.start, unnest(o.ps) AS p FROM pick t JOIN ordered o ON o.round = t.round AND o.doc_id = t.doc_id AND o.start = t.start AND o.k = t.k WHERE t.taken)"""


def picked(spark, sf):
    return P.picked_positions(instances(spark, sf), OPTIONS)


@query("g5_picked_positions", f"WITH RECURSIVE {SQL_PICKED} SELECT round, doc_id, start, CAST(p AS INTEGER) AS p FROM picked")
def g5(spark, sf):
    # The outer form keeps Spark from testing the size of ``positions`` first: that test would be pushed
    # below the steps that make them, and they would be made again for it.
    places = picked(spark, sf).select("round", "doc_id", "start", F.explode_outer("positions").alias("p"))
    return places.filter(F.col("p").isNotNull())


@query(
    "o4_sorted_positions",
    f"WITH RECURSIVE {SQL_PICKED} SELECT round, doc_id, start, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY p) AS positions FROM picked GROUP BY ALL",
)
def o4(spark, sf):
    return picked(spark, sf).select("round", "doc_id", "start", _text("positions").alias("positions"))


SQL_WORD_VOCAB = """
vocab_rows AS (SELECT DISTINCT unnest(tokens) AS token FROM segs),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY kind, place, token) - 1 AS INTEGER) AS id FROM (
    SELECT 0 AS kind, place, token FROM (VALUES """ + ", ".join(f"({i}, '{t}')" for i, t in enumerate(SPECIAL_TOKENS)) + """) AS s(place, token)
    UNION ALL SELECT 1, 0, token FROM vocab_rows)),
vocab_size AS (SELECT count(*) AS n FROM vocab)"""


def word_vocabulary(spark, tokens):
    distinct = tokens.select(F.explode("tokens").alias("token")).distinct()
    specials = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIAL_TOKENS)], "kind int, place int, token string")
    both = specials.union(distinct.select(F.lit(1), F.lit(0), "token"))
    return written(number_tokens(both), "vocabulary")


_DRAW = {n: u(f"'{n}'", "k.round", "k.doc_id", "k.start", "k.p") for n in ("mask80", "keep50", "token")}
SQL_MASKED = f"""{SQL_PICKED}, {SQL_WORD_VOCAB},
draws AS (SELECT k.*, CAST(floor({_DRAW['token']} * (SELECT n FROM vocab_size)) AS INTEGER) AS vid FROM picked k),
changes AS (SELECT k.round, k.doc_id, k.start, k.p, f.token AS label, CASE WHEN {_DRAW['mask80']} < 0.8 THEN '[MASK]' WHEN {_DRAW['keep50']} < 0.5 THEN f.token ELSE v.token END AS new
    FROM draws k JOIN flat f ON f.round = k.round AND f.doc_id = k.doc_id AND f.start = k.start AND f.i = k.p JOIN vocab v ON v.id = k.vid),
masked AS (SELECT f.round, f.doc_id, f.start, list(coalesce(c.new, f.token) ORDER BY f.i) AS tokens,
    coalesce(list(c.p ORDER BY f.i) FILTER (c.p IS NOT NULL), []) AS positions, coalesce(list(c.label ORDER BY f.i) FILTER (c.p IS NOT NULL), []) AS labels
    FROM flat f LEFT JOIN changes c ON f.round = c.round AND f.doc_id = c.doc_id AND f.start = c.start AND f.i = c.p GROUP BY ALL)"""


def masked(spark, sf):
    tokens = P.stored_segments(line_pieces(spark, sf))
    vocab = word_vocabulary(spark, tokens)
    return training_data.instances(tokens, vocab, OPTIONS, stored=True), vocab


@query(
    "g6_masked",
    f"WITH RECURSIVE {SQL_MASKED} SELECT round, doc_id, start, array_to_string(tokens, ' ') AS tokens, array_to_string(positions, ' ') AS positions, array_to_string(labels, ' ') AS labels FROM masked",
)
def g6(spark, sf):
    rows, _ = masked(spark, sf)
    return rows.select(
        "round", "doc_id", "start", _text("tokens").alias("tokens"),
        _text("masked_lm_positions").alias("positions"), _text("masked_lm_labels").alias("labels"),
    )


def _sql_pad(x: str, n: int, filler: str = "0") -> str:
    return f"array_to_string(flatten([{x}, list_transform(range(0, {n} - len({x})), lambda z: {filler})]), ' ')"


SQL_RECORDS = f"""{SQL_MASKED},
token_ids AS (SELECT m.round, m.doc_id, m.start, list(v.id ORDER BY m.i) AS ids FROM (SELECT round, doc_id, start, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM masked) m JOIN vocab v USING (token) GROUP BY ALL),
label_ids AS (SELECT m.round, m.doc_id, m.start, list(v.id ORDER BY m.i) AS lids FROM (SELECT round, doc_id, start, unnest(labels) AS token, generate_subscripts(labels, 1) AS i FROM masked) m JOIN vocab v USING (token) GROUP BY ALL),
placed AS (SELECT round, doc_id, start, row_number() OVER (ORDER BY {h("'instances'", 'round', 'doc_id', 'start')}, round, doc_id, start) - 1 AS position FROM masked),
records AS (SELECT round, doc_id, start, CAST(position % 4 AS INTEGER) AS shard, {_sql_pad('ids', 128)} AS input_ids, {_sql_pad('list_transform(ids, lambda q: 1)', 128)} AS input_mask,
    {_sql_pad('segment_ids', 128)} AS segment_ids, {_sql_pad('positions', 20)} AS positions, {_sql_pad('coalesce(lids, [])', 20)} AS label_ids,
    CAST(len(positions) AS DOUBLE) AS weight, CAST(is_random_next AS INTEGER) AS next_label
    FROM masked JOIN inst USING (round, doc_id, start) JOIN token_ids USING (round, doc_id, start) LEFT JOIN label_ids USING (round, doc_id, start) JOIN placed USING (round, doc_id, start))"""


def record_files(spark, sf):
    rows, vocab = masked(spark, sf)
    path = fresh_path(spark, "records")
    writers.write_records(training_data.records(training_data.kept(rows, vocab), vocab, 4, OPTIONS), path)
    return path


@query("s10_record_sink", f"WITH RECURSIVE {SQL_RECORDS} SELECT * FROM records")
def s10(spark, sf):
    return record_columns(spark.read.parquet(record_files(spark, sf)))


_EPOCH_ORDER = h("'epochs'", "epoch", "round", "doc_id", "start")


@query(
    "s11_record_source",
    f"WITH RECURSIVE {SQL_RECORDS}, numbered AS (SELECT e.epoch, r.round, r.doc_id, r.start, row_number() OVER (ORDER BY {_EPOCH_ORDER}, epoch, round, doc_id, start) - 1 AS position, count(*) OVER () AS n "
    "FROM records r, range(2) AS e(epoch)) SELECT CAST(epoch AS INTEGER) AS epoch, round, doc_id, start, position // 32 AS chunk FROM numbered WHERE position // 32 < n // 32",
)
def s11(spark, sf):
    rows = readers.read_records(spark, record_files(spark, sf), 128, 20)
    repeated = readers.epochs(rows, 2)
    numbered = P.shuffled(repeated, SEED, ["epoch", "round", "doc_id", "start"], "epochs")
    return G.full_chunks(numbered, 32).select("epoch", "round", "doc_id", "start", "chunk")


@query("a13_record_count", f"WITH RECURSIVE {SQL_PLAN} SELECT count(*) AS n FROM plan")
def a13(spark, sf):
    return spark.read.parquet(record_files(spark, sf)).agg(F.count("*").alias("n"))


# The whole job: lines of documents, tokenised with the demonstration vocabulary.
SQL_LINE_SEGS = """
text_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seg_no FROM documents),
lines AS (SELECT * FROM text_lines WHERE trim(line) <> ''), """ + sql_tokens("lines", "doc_id, seg_no", "line") + """,
segs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS INTEGER) AS seg_no, tokens FROM toks WHERE len(tokens) > 0),
""" + SQL_SEGS[SQL_SEGS.index("lengths AS"):]
SQL_JOB = SQL_RECORDS.replace(SQL_SEGS, SQL_LINE_SEGS).replace(SQL_WORD_VOCAB, "vocab_size AS (SELECT count(*) AS n FROM vocab)")


def record_columns(rows):
    weight = F.aggregate("masked_lm_weights", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select(
        "round", "doc_id", "start", "shard", _text("input_ids").alias("input_ids"), _text("input_mask").alias("input_mask"),
        _text("segment_ids").alias("segment_ids"), _text("masked_lm_positions").alias("positions"),
        _text("masked_lm_ids").alias("label_ids"), weight.alias("weight"), F.element_at("next_sentence_labels", 1).alias("next_label"),
    )


@query("g7_training_records", f"WITH RECURSIVE {SQL_JOB} SELECT * FROM records")
def g7(spark, sf):
    lines = P.segments(table(spark, sf, "documents"))
    vocab = demo_vocabulary(spark, sf)
    return record_columns(training_data.training_records(lines, vocab, 4, OPTIONS))


# ---- evaluation --------------------------------------------------------------------------------
# Logits are the vectors of the embeddings table, their labels and row numbers make weights;
# sentence pairs are the labelled documents.


def masked_predictions(spark, sf):
    weight = (F.col("label") / 10.0).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("logits"), "label", weight.alias("weight"))


def pair_predictions(spark, sf):
    quality, toxic = F.col("quality").cast("double"), F.col("toxic").cast("double")
    logits = F.array(quality * 2 - toxic, F.lit(0.5) + toxic)
    return table(spark, sf, "labels").select("doc_id", logits.alias("logits"), F.col("toxic").alias("label"))


SQL_MASKED_PRED = """
mp AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, label / CAST(10 AS DOUBLE) AS w FROM embeddings),
ms AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS shift FROM mp),
mq AS (SELECT *, shift - x[label + 1] AS nll, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS pred FROM ms)"""
SQL_PAIR_PRED = """
pp AS (SELECT doc_id, [quality * CAST(2 AS DOUBLE) - toxic, CAST(0.5 AS DOUBLE) + toxic] AS x, toxic AS label FROM labels),
ps AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS shift FROM pp),
pq AS (SELECT *, shift - x[label + 1] AS nll, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS pred FROM ps)"""


@query("m6_log_softmax", f"WITH {SQL_MASKED_PRED} SELECT vec_id, pred, round(nll, 6) AS nll, round(x[1] - shift, 6) AS first FROM mq")
def m6(spark, sf):
    rows = V.with_predictions(masked_predictions(spark, sf))
    first = F.element_at(Z.log_softmax(F.col("logits")), 1)
    return rows.select("vec_id", F.col("prediction").alias("pred"), F.round("nll", 6).alias("nll"), F.round(first, 6).alias("first"))


_MASK_HIT = "CAST(pred = label AS INTEGER)"


def metric_query(name: str, sql: str, source, metric):
    """One rounded metric over a prediction table."""

    @query(name, sql)
    def run(spark, sf):
        return V.with_predictions(source(spark, sf)).agg(F.round(metric(), 6).alias("out"))


metric_query("a8_weighted_accuracy", f"WITH {SQL_MASKED_PRED} SELECT round(sum(w * {_MASK_HIT}) / sum(w), 6) AS out FROM mq",
             masked_predictions, lambda: V.accuracy("prediction", "label", "weight"))
metric_query("a9_weighted_loss", f"WITH {SQL_MASKED_PRED} SELECT round(sum(w * nll) / sum(w), 6) AS out FROM mq",
             masked_predictions, lambda: V.mean("nll", "weight"))
metric_query("a10_accuracy", f"WITH {SQL_PAIR_PRED} SELECT round(avg({_MASK_HIT}), 6) AS out FROM pq",
             pair_predictions, lambda: V.accuracy("prediction", "label"))
metric_query("a10_mean_loss", f"WITH {SQL_PAIR_PRED} SELECT round(avg(nll), 6) AS out FROM pq",
             pair_predictions, lambda: V.mean("nll"))
metric_query("a11_masked_batch_loss", f"WITH {SQL_MASKED_PRED} SELECT round(sum(w * nll) / (sum(w) + CAST(0.00001 AS DOUBLE)), 6) AS out FROM mq",
             masked_predictions, lambda: V.masked_batch_loss("nll", "weight"))
metric_query("a12_pair_batch_loss", f"WITH {SQL_PAIR_PRED} SELECT round(avg(nll), 6) AS out FROM pq",
             pair_predictions, lambda: V.pair_batch_loss("nll"))

SQL_METRICS = f"""{SQL_MASKED_PRED}, {SQL_PAIR_PRED},
metrics AS (SELECT * FROM (SELECT sum(w * {_MASK_HIT}) / sum(w) AS masked_lm_accuracy, sum(w * nll) / sum(w) AS masked_lm_loss FROM mq),
    (SELECT avg({_MASK_HIT}) AS next_sentence_accuracy, avg(nll) AS next_sentence_loss FROM pq))"""


@query("c8_evaluate", "WITH " + SQL_METRICS + " SELECT " + ", ".join(
    f"round({m}, 6) AS {m}" for m in ("masked_lm_accuracy", "masked_lm_loss", "next_sentence_accuracy", "next_sentence_loss")) + " FROM metrics")
def c8(spark, sf):
    metrics = V.evaluate(masked_predictions(spark, sf), pair_predictions(spark, sf))
    return metrics.select(*[F.round(c, 6).alias(c) for c in metrics.columns])


@query(
    "s12_metric_lines",
    "WITH sizes AS (SELECT count(*) AS documents, sum(n_chars) AS characters FROM documents) "
    "SELECT 'characters = ' || CAST(characters AS VARCHAR) AS value FROM sizes UNION ALL SELECT 'documents = ' || CAST(documents AS VARCHAR) FROM sizes",
)
def s12(spark, sf):
    metrics = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    path = fresh_path(spark, "metrics")
    writers.write_metrics(V.as_lines(metrics), path)
    return spark.read.text(path)
