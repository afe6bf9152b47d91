"""Words counted by distinct parts of texts are those of the whole texts."""

from pyspark.sql import functions as F

from textmatch.operators import tokens as K
from textmatch.queries import load

TEXTS = [
    None, "", "   ", "ab  ab\tcd. ab", "ΟΔΟΣ ΟΔΟΣ. ΣΑ Σ x", "café café ́a e ́",
    "中文 a中b", "a b a b c d　e", "a\x00b \x00 a‍b �", "한국어 ொ kொ",
    "x\ny\r\nz a-b's “q”", "İ İ İstanbul", "a\x0bb a\x0cb a\x1cb a\x7fb \x0b",
]


def test_words_of_parts(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string")
    want = K.word_counts(K.words_of(texts, ["doc_id"], "text"))
    got = K.word_counts(K.words_of(K.part_counts(texts, "text"), ["n"], "part"), weight="n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_texts_are_split_once(spark, tmp_path):
    spark.createDataFrame([(1, "ab cd. ab"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("t11_word_pieces", "a14_first_pairs"):
        plan = load()[0][name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan
    counts = load()[0]["a14_word_counts"](spark, str(tmp_path))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part#" in plan  # words are found in distinct parts
    assert {r["word"]: r["n"] for r in counts.select("word", F.col("n")).collect()} == {"ab": 2, "cd": 1, ".": 1}
