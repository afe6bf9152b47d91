"""Cleaning, sentences, paragraphs and the text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import encoding as E, sentences as S
from ..session import fresh_path
from ..sources import readers, writers
from .common import (
    query, sql_clean, sql_clean_characters, sql_letters, sql_occurrences, sql_sentences, sql_space_ideographs,
    sql_spaces, table,
)

LINES = """
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""


def lines(spark, sf):
    """Untouched lines of all documents (doc_id, pos, line)."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def text_query(name: str, column, expression: str):
    """A query on one expression over the whole text of each document."""

    @query(name, f"SELECT doc_id, {expression} AS out FROM documents")
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", column(F.col("text")).alias("out"))


@query(
    "t1_split_sentences",
    """SELECT doc_id, CAST(generate_subscripts(string_split(lower(text), '.'), 1) - 1 AS INTEGER) AS pos,
    unnest(string_split(lower(text), '.')) AS piece FROM documents""",
)
def t1(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(T.raw_sentences(F.col("text"))).alias("pos", "piece")
    )


text_query("t2_letters_only", T.letters_only, sql_letters("text"))
text_query(
    "t3_single_blanks",
    T.single_blanks,
    "trim(regexp_replace(text, '[\\s\\x{B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+', ' ', 'g'))",
)
text_query("t4_count_spaces", lambda c: T.count_spaces(c).cast("bigint"), f"CAST({sql_spaces('text')} AS BIGINT)")

# The documents hold no chapter headings, so words found in them stand in.
BORDERS = ("The\nOf", "the of", " la ", "und")
CHAPTERS = ("the", "of")


def _sql_front_matter() -> str:
    sides = " ".join(
        f"WHEN contains(text, '{b.replace(chr(10), chr(39) + '||chr(10)||' + chr(39))}') "
        f"THEN split_part(text, '{b.replace(chr(10), chr(39) + '||chr(10)||' + chr(39))}', 2)"
        for b in BORDERS
    )
    return f"CASE {sides} ELSE text END"


def _sql_chapters(text: str, word: str, chapters, max_pieces: int) -> str:
    patterns = [f"{word}{a}{chapters[0]}(.*){word}{b}{chapters[1]}" for a in (" ", "  ") for b in (" ", "  ")]
    cuts = " ".join(
        f"WHEN regexp_matches({text}, '{p}', 's') THEN regexp_extract({text}, '{p}', 0, 's')" for p in patterns
    )
    return f"CASE WHEN len(string_split({text}, '{word}')) > {max_pieces} THEN {text} {cuts} ELSE {text} END"


text_query("t5_front_matter", lambda c: T.after_front_matter(c, BORDERS), _sql_front_matter())
text_query(
    "t6_required_chapters",
    lambda c: T.required_chapters(c, CHAPTERS, 40, "is"),
    _sql_chapters("text", "is", CHAPTERS, 40),
)
text_query(
    "p11_regular_report",
    lambda c: T.is_regular_report(c, 6, "The"),
    "len(string_split(text, 'The')) <= 6",
)

PARAGRAPHS = f"""
pieces AS (SELECT doc_id, CASE WHEN len(string_split(text, chr(10) || chr(10))) > 20 THEN string_split(text, chr(10) || chr(10))
    WHEN len(string_split(text, chr(10))) > 20 THEN string_split(text, chr(10)) ELSE string_split(text, '.') END AS ps FROM {{source}}),
flat AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pieces),
cleaned AS (SELECT doc_id, i, {sql_clean('p')} AS sentence FROM flat),
paragraphs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, sentence
    FROM cleaned WHERE {sql_spaces('sentence')} > 26)"""
SEPARATORS = ("\n\n", "\n", ".")


@query("t7_paragraphs", f"WITH {PARAGRAPHS.format(source='documents')} SELECT * FROM paragraphs")
def t7(spark, sf):
    kept = T.paragraph_array(F.col("text"), SEPARATORS)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(kept).alias("pos", "sentence"))


text_query("t8_clean_characters", U.clean_characters, sql_clean_characters("text"))
text_query("t9_space_ideographs", U.space_ideographs, sql_space_ideographs("text"))


@query(
    "t10_basic_tokens",
    f"WITH {sql_occurrences('documents', 'doc_id', 'text', 'occ')} SELECT doc_id, CAST(tok AS INTEGER) AS tok, word FROM occ",
)
def t10(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(U.basic_tokens(F.col("text"))).alias("tok", "word")
    )


@query(
    "t13_split_pairs",
    """WITH turns AS (SELECT conv_id, turn, string_agg(role || ' ||| ' || text, ' ') AS text FROM conversations GROUP BY ALL)
    SELECT conv_id, turn,
    CASE WHEN regexp_matches(t, '^(.*) \\|\\|\\| (.*)$') THEN regexp_extract(t, '^(.*) \\|\\|\\| (.*)$', 1) ELSE t END AS text_a,
    CASE WHEN regexp_matches(t, '^(.*) \\|\\|\\| (.*)$') THEN regexp_extract(t, '^(.*) \\|\\|\\| (.*)$', 2) END AS text_b
    FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM turns)""",
)
def t13(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("text", F.concat_ws(" ||| ", "role", "text"))
    return E.split_pairs(turns, "text").select("conv_id", "turn", "text_a", "text_b")


text_query(
    "t17_decode_bytes",
    lambda c: U.decode_text(F.concat(F.encode(c, "UTF-8"), F.unhex(F.lit("FF")))),
    "text",
)


@query("p5_important_lines", f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM raw WHERE {sql_spaces('line')} > 26")
def p5(spark, sf):
    return lines(spark, sf).filter(T.is_important(F.col("line")))


@query(
    "p6_no_contents_lists",
    f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM raw WHERE {sql_spaces('line', '.')} < 3",
)
def p6(spark, sf):
    return lines(spark, sf).filter(~T.is_contents_list(F.col("line"), 3))


@query("c1_sentences", f"WITH {sql_sentences()} SELECT * FROM sentences")
def c1(spark, sf):
    return S.sentences(table(spark, sf, "documents"))


_BODY = (
    f"body AS (SELECT doc_id, {_sql_front_matter()} AS body FROM documents), "
    f"cut AS (SELECT doc_id, {_sql_chapters('body', 'is', CHAPTERS, 40)} AS text FROM body)"
)


@query("c2_paragraphs", f"WITH {_BODY}, {PARAGRAPHS.format(source='cut')} SELECT * FROM paragraphs")
def c2(spark, sf):
    from dataclasses import replace

    from ..options import DEFAULTS

    options = replace(DEFAULTS, chapters=CHAPTERS, max_chapter_pieces=40)
    return S.paragraphs(
        table(spark, sf, "documents"), options, borders=BORDERS, separators=SEPARATORS, chapter_word="is"
    )


# ---- sources and sinks ---------------------------------------------------------


@query("s3_document_files", "SELECT item_id, rtrim(text, chr(10)) AS text FROM benchmark")
def s3(spark, sf):
    path = fresh_path(spark, "files")
    table(spark, sf, "benchmark").write.partitionBy("item_id").text(path)
    docs = readers.read_documents(spark, path + "/*/*")
    item = F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("bigint")
    return docs.select(item.alias("item_id"), F.rtrim("text", F.lit("\n")).alias("text"))


_CORPUS_SQL = f"""WITH {sql_sentences()}
SELECT count(*) AS n_lines, string_agg(sentence, chr(10) ORDER BY pos) AS text FROM sentences GROUP BY doc_id"""


def _corpus(spark, sf):
    path = fresh_path(spark, "corpus")
    writers.append_corpus(S.sentences(table(spark, sf, "documents")), path)
    return readers.read_training_corpus(spark, path)


@query("s4_training_corpus", _CORPUS_SQL)
def s4(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("block", "line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    grouped = _corpus(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"), text.alias("text"))
    return grouped.select("n_lines", "text")


@query(
    "w2_document_numbers",
    f"WITH {sql_sentences()}, sizes AS (SELECT doc_id, count(*) AS n_lines FROM sentences GROUP BY doc_id) "
    "SELECT n_lines, count(*) AS n_docs FROM sizes GROUP BY n_lines",
)
def w2(spark, sf):
    sizes = _corpus(spark, sf).groupBy("file", "doc_no").agg(F.count("*").alias("n_lines"))
    return sizes.groupBy("n_lines").agg(F.count("*").alias("n_docs"))


@query(
    "s5_vocabulary_file",
    """WITH parts AS (SELECT item_id, unnest(string_split(text, ' ')) AS w,
        generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
    words AS (SELECT item_id, i, unnest(string_split(w, chr(10))) AS w, generate_subscripts(string_split(w, chr(10)), 1) AS j FROM parts),
    numbered AS (SELECT w, row_number() OVER (ORDER BY item_id, i, j) - 1 AS id FROM words)
    SELECT w AS token, CAST(max(id) AS INTEGER) AS id FROM numbered GROUP BY w""",
)
def s5(spark, sf):
    path = fresh_path(spark, "vocab")
    # A vocabulary is one file, and its lines are the ids: one value, written as it is.
    lines = F.array_sort(F.collect_list(F.struct("item_id", "text")))
    words = F.flatten(F.transform(lines, lambda x: F.split(x["text"], "[ \n]", -1)))
    table(spark, sf, "benchmark").agg(F.array_join(words, "\n").alias("value")).write.text(path)
    return readers.read_vocabulary(spark, path)


@query(
    "s9_clean_texts",
    f"WITH {sql_sentences()} SELECT d.doc_id, coalesce(string_agg(sentence, chr(10) ORDER BY pos), '') AS text "
    "FROM documents d LEFT JOIN sentences s ON s.doc_id = d.doc_id GROUP BY d.doc_id",
)
def s9(spark, sf):
    path = fresh_path(spark, "clean")
    docs = table(spark, sf, "documents")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    writers.write_clean_texts(labelled, path)
    writers.write_clean_texts(docs, path)  # adds the documents not stored by the first run
    return spark.read.parquet(path)


@query(
    "j10_not_done",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def j10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return S.not_done(docs, table(spark, sf, "labels"))
