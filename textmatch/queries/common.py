"""Registry of checkable queries, and SQL text that several of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..options import DEFAULTS, SPECIAL_TOKENS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` it is checked by tests on small fixtures."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- texts -------------------------------------------------------------------


def sql_letters(x: str) -> str:
    bare = f"replace(replace({x}, '\\n', ''), chr(10), '')"
    return f"replace(regexp_replace({bare}, '[^.a-zA-Z ]+', '', 'g'), ' .', '.')"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace({sql_letters(x)}, ' +', ' ', 'g'))"


def sql_spaces(x: str, char: str = " ") -> str:
    return f"(length({x}) - length(replace({x}, '{char}', '')))"


def sql_sentences(source: str = "documents", key: str = "doc_id", min_space: int = 26, name: str = "sentences") -> str:
    return f"""
{name}_raw AS (SELECT {key} AS doc_id, unnest(string_split(lower(text), '.')) AS s,
    generate_subscripts(string_split(lower(text), '.'), 1) AS i FROM {source}),
{name}_clean AS (SELECT doc_id, i, {sql_clean('s')} AS sentence FROM {name}_raw),
{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, sentence
    FROM {name}_clean WHERE {sql_spaces('sentence')} > {min_space})"""


# ---- tokens ------------------------------------------------------------------

_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


def sql_clean_characters(x: str) -> str:
    dropped = f"regexp_replace({x}, '[\\x{{0}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}\\p{{Cf}}\\x{{FFFD}}]', '', 'g')"
    return f"regexp_replace({dropped}, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g')"


def sql_space_ideographs(x: str) -> str:
    return f"regexp_replace({x}, '({_CJK})', ' \\1 ', 'g')"


def sql_words(x: str) -> str:
    """List of basic tokens of a text."""
    plain = f"strip_accents(lower({sql_space_ideographs(sql_clean_characters(x))}))"
    spaced = f"regexp_replace({plain}, '([!-/:-@\\[-`{{-~\\p{{P}}])', ' \\1 ', 'g')"
    return f"list_filter(string_split_regex({spaced}, '[ \\x{{2028}}\\x{{2029}}]+'), lambda w: w <> '')"


def sql_occurrences(source: str, keys: str, text: str, name: str) -> str:
    """One row per word occurrence: keys, tok, word."""
    words = f"{name}_lists AS (SELECT {keys}, {sql_words(text)} AS ws FROM {source})"
    return f"""
{words},
{name} AS (SELECT {keys}, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok FROM {name}_lists)"""


MAX_SHORT = 4  # the demonstration vocabulary holds all words up to this length
_specials = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SPECIAL_TOKENS))

# Special tokens, all letters and all short words, each also as a continuation.
SQL_VOCAB = (
    sql_occurrences("documents", "doc_id", "text", "vocab_words")
    + f""",
vocab_distinct AS (SELECT DISTINCT word FROM vocab_words),
vocab_pieces AS (
    SELECT DISTINCT unnest(string_split(word, '')) AS p FROM vocab_distinct
    UNION SELECT word FROM vocab_distinct WHERE length(word) <= {MAX_SHORT}),
vocab_all AS (
    SELECT 0 AS kind, id AS place, token FROM (VALUES {_specials}) AS s(id, token)
    UNION ALL SELECT 1, 0, p FROM vocab_pieces
    UNION ALL SELECT 2, 0, '##' || p FROM vocab_pieces),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY kind, place, token) - 1 AS INTEGER) AS id FROM vocab_all)"""
)


def demo_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vocabulary from the documents table (token, id)."""
    from ..operators.tokens import part_counts, words_of
    from ..operators.vocabulary import number_tokens
    from ..session import written

    words = words_of(part_counts(table(spark, sf_dir, "documents"), "text"), [], "part")
    words = words.filter(F.col("word").isNotNull()).select("word").distinct()
    short = F.when(F.length("word") <= MAX_SHORT, F.array("word")).otherwise(F.array().cast("array<string>"))
    pieces = words.select(F.explode(F.concat(F.split("word", ""), short)).alias("p")).distinct()
    forms = F.array(
        F.struct(F.lit(1).alias("kind"), F.lit(0).alias("place"), F.col("p").alias("token")),
        F.struct(F.lit(2).alias("kind"), F.lit(0).alias("place"), F.concat(F.lit("##"), F.col("p")).alias("token")),
    )
    specials = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIAL_TOKENS)], "kind int, place int, token string")
    both = specials.union(pieces.select(F.inline(forms)))
    # Read by every task of a tokenisation, so it is computed once.
    return written(number_tokens(both), "vocabulary")


def sql_pieces(occurrences: str, name: str = "pieces", walk: str = "walk") -> str:
    """Word pieces of all distinct words: (word, pieces, ids). Needs RECURSIVE."""
    return f"""
{name}_words AS (SELECT DISTINCT word FROM {occurrences}),
{name}_longest AS (SELECT max(length(regexp_replace(token, '^##', ''))) AS m FROM vocab),
{name}_starts AS (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM {name}_words WHERE length(word) <= 200),
{name}_spans AS (SELECT word, s, unnest(range(1, least(length(word) - s + 1, m) + 1)) AS l FROM {name}_starts, {name}_longest),
{name}_match AS (SELECT word, s, max(l) AS l FROM {name}_spans
    JOIN vocab ON vocab.token = CASE WHEN s > 1 THEN '##' ELSE '' END || substring(word, s, l) GROUP BY word, s),
{walk}(word, nxt, pieces) AS (
    SELECT word, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM {name}_words
    UNION ALL
    SELECT w.word, w.nxt + m.l, list_append(w.pieces, CASE WHEN m.s > 1 THEN '##' ELSE '' END || substring(m.word, m.s, m.l))
    FROM {walk} w JOIN {name}_match m ON m.word = w.word AND m.s = w.nxt),
{name} AS (SELECT d.word, coalesce(w.pieces, ['[UNK]']) AS pieces FROM {name}_words d
    LEFT JOIN {walk} w ON w.word = d.word AND w.nxt = length(d.word) + 1)"""


def sql_tokens(source: str, keys: str, text: str, name: str = "toks") -> str:
    """Token lists of texts (keys, tokens), including empty ones, by the demo vocabulary."""
    k0 = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return (
        SQL_VOCAB
        + ","
        + sql_occurrences(source, keys, text, f"{name}_occ")
        + ","
        + sql_pieces(f"{name}_occ", f"{name}_wp", f"{name}_walk")
        + f""",
{name}_some AS (SELECT {keys}, flatten(list(pieces ORDER BY tok)) AS tokens
    FROM {name}_occ JOIN {name}_wp USING (word) GROUP BY {keys}),
{name} AS (SELECT {k0}, coalesce(t.tokens, CAST([] AS VARCHAR[])) AS tokens
    FROM {source} s LEFT JOIN {name}_some t USING ({keys}))"""
    )


# ---- vectors -----------------------------------------------------------------

# Documents and files of the embeddings table are its labels.
SQL_UNIT = """
lengths AS (SELECT vec_id, label, embedding,
    sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS len FROM embeddings),
unit AS (SELECT vec_id, CAST(label AS BIGINT) AS file_id,
    list_transform(embedding, lambda x: CAST(CASE WHEN len = 0 THEN 0 ELSE x / len END AS FLOAT)) AS e FROM lengths)"""

SQL_SCORED = (
    SQL_UNIT
    + """,
scored AS (SELECT q.file_id AS doc_id, q.vec_id AS query_id, c.file_id, c.vec_id,
    round(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])), 6) AS score FROM unit q, unit c)"""
)

THRESHOLD = 0.25  # no two distinct vectors of the table reach the default
K = 10


def sql_hits(k: int | None = K, threshold: float = THRESHOLD) -> str:
    ranked = f"""{SQL_SCORED},
over AS (SELECT * FROM scored WHERE score > {threshold}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id ORDER BY score DESC, file_id, vec_id) AS rn FROM over)"""
    return ranked + f", hits AS (SELECT * FROM ranked{'' if k is None else f' WHERE rn <= {k}'})"


# One centre per label: the unit-length mean of its vectors.
SQL_CENTROIDS = """
members AS (SELECT file_id AS cell, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM unit),
means AS (SELECT cell, i, avg(CAST(x AS DOUBLE)) AS m FROM members GROUP BY cell, i),
centre_len AS (SELECT cell, sqrt(sum(m * m)) AS len FROM means GROUP BY cell),
centroids AS (SELECT cell, list(m / len ORDER BY i) AS c FROM means JOIN centre_len USING (cell) GROUP BY cell)"""

SQL_CELLS = (
    SQL_UNIT
    + ","
    + SQL_CENTROIDS
    + """,
cell_scores AS (SELECT vec_id, file_id, cell, round(list_dot_product(CAST(e AS DOUBLE[]), c), 6) AS s FROM unit, centroids),
cell_ranks AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) AS rn FROM cell_scores),
cells AS (SELECT vec_id, file_id, CAST(cell AS INTEGER) AS cell, s FROM cell_ranks WHERE rn = 1)"""
)


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-length corpus vectors (file_id, vec_id, token, embedding)."""
    from ..functions.vectors import normalise, to_float32

    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("file_id"),
        "vec_id",
        F.lit("").alias("token"),
        normalise(to_float32(F.col("embedding"))).alias("embedding"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors as queries (doc_id, query_id, embedding)."""
    rows = corpus_vectors(spark, sf_dir)
    return rows.select(F.col("file_id").alias("doc_id"), F.col("vec_id").alias("query_id"), "embedding")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centre per label (cell, centroid); few rows, whatever the table size."""
    flat = corpus_vectors(spark, sf_dir).select("file_id", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("file_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    lists = means.groupBy("file_id").agg(F.transform(ordered, lambda s: s["m"]).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return lists.select(
        F.col("file_id").cast("int").alias("cell"), F.transform("m", lambda x: x / length).alias("centroid")
    )


def demo_index(spark: SparkSession, sf_dir: str):
    """A stored index of the embeddings table around the label centres."""
    from ..plans.indexing import build_index
    from ..session import fresh_path

    return build_index(
        corpus_vectors(spark, sf_dir), fresh_path(spark, "index"), centroids=label_centroids(spark, sf_dir)
    )


LOW = replace(DEFAULTS, threshold=THRESHOLD, neighbours=K)
